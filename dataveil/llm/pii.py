"""Personal data: candidate spans from high-recall patterns, boosted trees, calibrated thresholds.

Everything runs in DataFrame expressions. The base patterns find e-mail addresses, IP addresses, card
numbers and phone numbers; their matches that pass the kind's check are spans, whatever the model
says. Further patterns propose, with high recall, addresses written with (at), phone numbers without a
country code, and identity and account numbers; and the cards, addresses and phone numbers that begin and
end at the borders of digit groups in or across base matches that fail their check. Proposals may overlap:
each pattern is matched on its own, most of them at every place and with every end. The model scores all,
and of chosen ones that overlap the likeliest stays, then the longest.

Every candidate has a few small format and context features, so that all candidates of a corpus fall
into at most ``CELLS`` cells. The trees are trained on these cells, weighted with their counts; labels are
what each kind's own check says: octets, the card checksum, the number of digits, a top-level domain of
letters, the account checksum, issued identity numbers. Scores of whole cells that a model has not seen
set a threshold per kind, the least at which their candidates reach ``PRECISION``. Proposals in cells above
it become spans. Cell counts cover the whole corpus, and the training data has the same bound at every
size. The work on a text grows with its spans, to the power of 1.5 where most proposals are chosen.

Patterns are possessive and anchored, which finds the same leftmost matches as the plain forms in time
linear in the text.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.functions.masks import quoted
from dataveil.llm.folds import MAX, SUM, running
from dataveil.llm.store import stored

# The base patterns in their linear form, and a cheap test that each of them implies.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
PROPOSED = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{1,63})++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "id": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
# A cheap test that each of them implies.
PROPOSED_TEST = {"email": r"[(\[]at[)\]]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}", "id": r"-[0-9]{2}-[0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"}
_IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){%s}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_PHONE = r"\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
_IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Proposals that may start inside others: what is not before a start, the longest match, every match to be proposed, and a test.
WINDOWS = {
    "ip": ("[0-9]", _IP, (_IP,), BASE["ip"][1]),
    "card": ("[0-9]", r"[0-9](?:[\x20-]?[0-9]){12,18}", tuple(rf"[0-9](?:[\x20-]?[0-9]){{{n - 1}}}(?![0-9])" for n in range(13, 20)), BASE["card"][1]),
    "phone": ("[0-9+.-]", _PHONE, (_PHONE,), PROPOSED_TEST["phone"]),
    "iban": ("[A-Za-z0-9]", _IBAN % "2,7", tuple(_IBAN % n for n in range(2, 8)), PROPOSED_TEST["iban"]),
}
# Beginnings of a base phone match that fails its check.
PREFIXES = tuple(rf"\+[0-9](?:[\x20().-]*+[0-9]){{{n - 1}}}(?![0-9])" for n in range(9, 16))
KINDS = ("email", "ip", "card", "phone", "id", "iban")
FAMILY = {kind: number for number, kind in enumerate(KINDS)}
CONTEXT = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|account|iban|ssn|passport|host|server|addr)"
FEATURES = ("family", "digits", "separators", "before", "after", "context")
LEVELS = (6, 6, 4, 4, 4, 2)
CELLS = 6 * 6 * 4 * 4 * 4 * 2
FOLDS = 3
PRECISION = 0.9


def _cuts(text: str, name: str, pattern: str, test: str, df: DataFrame) -> DataFrame:
    """*df* with the pattern's matches and the pieces between them, skipped where the test fails."""
    meets = F.col(text).rlike(test)
    none = F.array().cast("array<string>")
    return df.withColumns({
        f"_hits_{name}": F.when(meets, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none),
        f"_gaps_{name}": F.when(meets, F.split(F.col(text), pattern, -1)).otherwise(none),
    })


def _near(name: str) -> Column:
    """Matches with their sizes, up to 24 characters before and one after."""
    gaps = F.col(f"_gaps_{name}")
    return F.transform(f"_hits_{name}", lambda h, i: F.struct(
        h.alias("hit"), F.length(h).alias("size"), F.length(F.get(gaps, i)).alias("gap"), F.right(F.get(gaps, i), F.lit(24)).alias("left"),
        F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"),
    ))


def _placed(df: DataFrame, names: list[str]) -> DataFrame:
    """*df* with the spans of each name, in code points: the sums of what stands before them, in place of ``_near_``."""
    sized = df.withColumns({f"_sizes_{n}": F.transform(f"_near_{n}", lambda x: x["gap"] + x["size"]) for n in names})
    summed = running(sized, {f"_at_{n}": f"_sizes_{n}" for n in names}, SUM)
    spans = {n: F.zip_with(f"_near_{n}", f"_at_{n}", lambda x, at: F.struct(
        (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit"), x["left"].alias("left"), x["right"].alias("right"),
    )) for n in names}
    return summed.withColumns(spans).drop(*[f"_{step}_{n}" for n in names for step in ("near", "sizes", "at")])


def _window_cuts(text: str, kind: str, df: DataFrame) -> DataFrame:
    """*df* with the windows of a kind, each from a start to one character past the longest match, and the pieces between starts."""
    before, longest, _, test = WINDOWS[kind]
    pattern = rf"(?<!{before})(?=({longest}[\s\S]?))"
    meets = F.col(text).rlike(test)
    none = F.array().cast("array<string>")
    return df.withColumns({
        f"_hits_window_{kind}": F.when(meets, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).otherwise(none),
        f"_gaps_window_{kind}": F.when(meets, F.split(F.col(text), pattern, -1)).otherwise(none),
    })


def _prefixes(window: Column, patterns: tuple[str, ...], start: Column, left: Column, past: Column) -> Column:
    """The patterns' matches at the begin of *window* as spans; *past* is what follows the window."""
    found = F.filter(F.array_distinct(F.array(*[F.regexp_extract(window, f"^(?:{p})", 0) for p in patterns])), lambda h: h != "")
    return F.transform(found, lambda h: F.struct(
        start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"), left.alias("left"),
        F.when(F.length(h) < F.length(window), F.substring(window, F.length(h) + 1, F.lit(1))).otherwise(past).alias("right"),
    ))


def _near_window(kind: str) -> Column:
    """Windows like the matches of ``_near``, of size 0, as the pieces are cut between starts."""
    gaps = F.col(f"_gaps_window_{kind}")
    # Starts are two characters apart at least, so that twelve pieces hold 24.
    return F.transform(f"_hits_window_{kind}", lambda h, i: F.struct(
        h.alias("hit"), F.lit(0).alias("size"), F.length(F.get(gaps, i)).alias("gap"),
        F.right(F.array_join(F.slice(gaps, F.greatest(i - 10, F.lit(1)), F.least(i + 1, F.lit(12))), ""), F.lit(24)).alias("left"), F.lit("").alias("right"),
    ))


def _window_spans(kind: str) -> Column:
    """Every match to be proposed at every start, as spans like those of ``_placed``."""
    return F.flatten(F.transform(f"window_{kind}", lambda w: _prefixes(w["hit"], WINDOWS[kind][2], w["start"], w["left"], F.lit(""))))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of 13 to 19 digits passes the card checksum."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.translate(hit, " -", "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _iban(hit: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97, its first four signs last and letters as numbers from 10."""
    text = F.regexp_replace(hit, " ", "")
    signs = F.split(F.concat(F.substring(text, F.lit(5), F.length(text)), F.left(text, F.lit(4))), "")

    def step(acc: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(signs, F.lit(0), step) == 1


def _label(kind: str, hit: Column, passes: Column) -> Column:
    """What a match's own check says of it, for training: also where the base span stays in any case."""
    if kind == "email":
        return hit.rlike(r"[.][A-Za-z]{2,}\z")
    if kind == "id":
        return ~hit.rlike(r"^(?:000|666|9)|-00-|-0000\z")
    return _iban(hit) if kind == "iban" else passes


def _border(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == "") | c.rlike(r"[\x20\x09-\x0D]"), 0).when(c.rlike("[A-Za-z0-9]"), 2).when(c.rlike(r"[\x21-\x7E]"), 1).otherwise(3)
    )


def _cell(kind: Column, x: Column) -> Column:
    """Number of a candidate's cell: its features as digits of one number."""
    family = F.lit(0)
    for name, number in FAMILY.items():
        family = F.when(kind == name, number).otherwise(family)
    digits = F.least(F.floor(F.length(_digits(x["hit"])) / 4), F.lit(5))
    marks = F.length(F.regexp_replace(x["hit"], r"[^\x20().-]", ""))
    values = (family, digits, F.least(F.ceil(marks / 2), F.lit(3)), _border(F.right(x["left"], F.lit(1))), _border(x["right"]), F.when(x["left"].rlike(CONTEXT), 1).otherwise(0))
    code = F.lit(0)
    for value, levels in zip(values, LEVELS):
        code = code * levels + value
    return code.cast("int")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): every row's candidates (kind, start, end, cell, base), base being true for a
    span, false for a base match that fails its check, and null for a proposal that meets no span."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    for kind, (pattern, test) in BASE.items():
        df = _cuts("_text", kind, pattern, test, df)
    plain = [name for name in PROPOSED if name not in WINDOWS]
    for name in plain:
        df = _cuts("_text", f"proposed_{name}", PROPOSED[name], PROPOSED_TEST[name], df)
    for kind in WINDOWS:
        df = _window_cuts("_text", kind, df)
    # A text that begins with a window has no piece before it.
    df = df.withColumns({f"_gaps_window_{k}": F.when(
        F.size(f"_gaps_window_{k}") == F.size(f"_hits_window_{k}"), F.concat(F.array(F.lit("")), f"_gaps_window_{k}")).otherwise(F.col(f"_gaps_window_{k}")) for k in WINDOWS})
    matched = [*BASE, *[f"proposed_{name}" for name in plain]]
    windows = [f"window_{kind}" for kind in WINDOWS]
    df = df.select("doc_id", *[_near(n).alias(f"_near_{n}") for n in matched], *[_near_window(k).alias(f"_near_window_{k}") for k in WINDOWS])
    df = _placed(df, [*matched, *windows])
    df = df.withColumns({f"window_{k}": _window_spans(k) for k in WINDOWS})

    def candidate(kind: str, x: Column, base: Column, label: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _cell(F.lit(kind), x).alias("cell"), base.alias("base"), label.alias("label"),
        )

    def of_base(kind: str) -> Column:
        checked = F.transform(F.col(kind), lambda x: F.struct(x["start"], x["end"], x["hit"], x["left"], x["right"], _passes(kind, x["hit"]).alias("passes")))
        return F.transform(checked, lambda x: candidate(kind, x, x["passes"], _label(kind, x["hit"], x["passes"])))

    def proposed(kind: str, spans: Column) -> Column:
        unknown = F.lit(None).cast("boolean")
        return F.transform(spans, lambda x: candidate(kind, x, unknown, _label(kind, x["hit"], unknown) if kind in ("id", "iban") else unknown))

    def checked(kind: str) -> Column:
        return F.filter(f"window_{kind}", lambda x: _passes(kind, x["hit"]))

    failed = F.filter("phone", lambda x: ~_passes("phone", x["hit"]))
    inner = F.flatten(F.transform(failed, lambda x: _prefixes(x["hit"], PREFIXES, x["start"], x["left"], x["right"])))
    df = df.select(
        "doc_id", F.concat(*[of_base(k) for k in BASE]).alias("base"),
        F.concat(
            *[proposed(name, F.col(f"proposed_{name}")) for name in plain], proposed("phone", inner),
            *[proposed(k, checked(k) if k in ("ip", "card") else F.col(f"window_{k}")) for k in WINDOWS],
        ).alias("proposed"),
    )
    return _with_free(df).select("doc_id", F.concat("base", "free").alias("found"))


def _with_free(df: DataFrame) -> DataFrame:
    """*df* (base, proposed) with ``free``, the proposals that meet no base span: up to a proposal's end no such span ends after its start.

    Starts of spans and ends of proposals are put in one order, through which the furthest end runs.
    """
    passed = F.filter("base", lambda b: b["base"])
    starts = F.transform(passed, lambda b: F.struct(b["start"].alias("key"), F.lit(1).alias("span"), b["end"].alias("at"), F.lit(-1).alias("number")))
    ends = F.transform("proposed", lambda p, i: F.struct(p["end"].alias("key"), F.lit(0).alias("span"), p["start"].alias("at"), i.alias("number")))
    events = df.withColumn("_events", F.array_sort(F.concat(starts, ends)))
    reached = events.withColumn("_ends", F.transform("_events", lambda e: F.when(e["span"] == 1, e["at"]).otherwise(F.lit(-1))))
    told = running(reached, {"_furthest": "_ends"}, MAX).withColumn("_told", F.zip_with("_events", "_furthest", lambda e, far: F.struct(
        e["number"].alias("number"), ((e["span"] == 0) & (far <= e["at"])).alias("clear"),
    )))
    clear = told.withColumn("_clear", F.array_sort(F.transform(F.filter("_told", lambda t: t["clear"]), lambda t: t["number"])))
    return clear.withColumn("free", F.transform("_clear", lambda i: F.get("proposed", i))).drop("_events", "_ends", "_furthest", "_told", "_clear")


def _model(points: DataFrame):
    """Boosted trees for the labelled cells of *points*, or the only label there is."""
    found = [r["label"] for r in points.select("label").distinct().collect()]
    if len(found) < 2:
        return found[0] if found else 0.0
    return GBTClassifier(labelCol="label", weightCol="weight", maxDepth=4, maxIter=8, stepSize=0.3, seed=3).fit(points)


def _chances(model, points: DataFrame) -> DataFrame:
    if isinstance(model, float):
        return points.withColumn("p", F.lit(model))
    return model.transform(points).withColumn("p", vector_to_array("probability").getItem(1))


def _thresholds(told: list[tuple[int, float, float, int]]) -> dict[int, float]:
    """By family the least chance at which the candidates of held-out cells, (family, chance, label, n), reach ``PRECISION``.

    A family without labelled cells gets the threshold of all families together.
    """
    found = {}
    for family in range(len(KINDS)):
        rows = [t for t in told if t[0] == family] or told
        good = total = 0
        found[family] = 2.0
        ranked = sorted(rows, key=lambda t: -t[1])
        for k, (_, p, label, n) in enumerate(ranked):
            good, total = good + n * label, total + n
            if (k + 1 == len(ranked) or ranked[k + 1][1] < p) and good >= PRECISION * total:
                found[family] = p
    return found


def _trained(cells: DataFrame) -> dict[int, float]:
    """Scores of the cells whose proposals become spans. *cells* (cell, label, proposed, n) has at most 6 * CELLS rows.

    Every cell is scored by a model that has not seen it, one per fold of whole cells; these scores
    set the thresholds. The model of all cells scores the proposals.
    """
    spread = cells
    below = 1
    for name, levels in reversed(list(zip(FEATURES, LEVELS))):
        spread = spread.withColumn(name, (F.floor(F.col("cell") / below) % levels).cast("double"))
        below *= levels
    points = stored(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(spread).coalesce(1), "pii-points")
    known = points.where("label is not null").withColumns({
        "label": F.col("label").cast("double"), "weight": F.col("n").cast("double"), "fold": F.pmod(F.xxhash64("cell"), F.lit(FOLDS)),
    })
    if known.select("label").distinct().count() < 2 or points.where("proposed").isEmpty():
        return {}
    told = []
    for fold in range(FOLDS):
        scored = _chances(_model(known.where(F.col("fold") != fold)), known.where(F.col("fold") == fold))
        told += [(int(r["family"]), r["p"], r["label"], r["n"]) for r in scored.select("family", "p", "label", "n").collect()]
    least = _thresholds(told)
    final = _chances(_model(known), points.where("proposed").select("cell", "family", "features").distinct())
    return {r["cell"]: r["p"] for r in final.select("cell", "family", "p").collect() if r["p"] >= least[int(r["family"])]}


def _with_apart(df: DataFrame, spans: str) -> DataFrame:
    """*df* with ``apart``, those of the spans (score, kind, start, end) left when no two may overlap: by score, then length, then place.

    Kept spans lie in as many stretches of the text as the root of their number; a span is compared
    with those of its own stretches only.
    """
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = df.withColumn("_ranked", F.array_sort(F.transform(spans, lambda c: F.struct(
        (-c["score"]).alias("low"), (c["start"] - c["end"]).alias("less"), c["start"].alias("start"), F.array_position(order, c["kind"]).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"),
    ))))
    length = F.coalesce(F.array_max(F.transform("_ranked", lambda c: c["end"])), F.lit(0))
    sized = ranked.withColumn("_length", length).withColumn(
        "_width", F.greatest(F.ceil(F.col("_length") / F.greatest(F.sqrt(F.size("_ranked")), F.lit(1.0))), F.lit(64)).cast("int")
    )
    width = F.col("_width")
    held = "array<struct<kind:string,start:int,end:int,first:boolean>>"
    begin = F.transform(F.sequence(F.lit(0), F.floor(F.col("_length") / width).cast("int")), lambda _: F.array().cast(held))

    def take(kept: Column, c: Column) -> Column:
        low, high = F.floor(c["start"] / width).cast("int"), F.floor(F.greatest(c["end"] - 1, c["start"]) / width).cast("int")
        meets = F.exists(F.slice(kept, low + 1, high - low + 1), lambda own: F.exists(own, lambda k: (k["start"] < c["end"]) & (k["end"] > c["start"])))
        span = lambda i: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (i == low).alias("first"))
        return F.when(meets, kept).otherwise(F.transform(kept, lambda own, i: F.when(i.between(low, high), F.concat(own, F.array(span(i)))).otherwise(own)))

    kept = sized.withColumn("_kept", F.aggregate("_ranked", begin, take))
    return kept.withColumn("apart", F.filter(F.flatten("_kept"), lambda c: c["first"])).drop("_ranked", "_length", "_width", "_kept")


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, added): the spans (kind, start, end) of every row of *docs* (doc_id, text).

    Positions count code points, the end is exclusive. *spans* are the base spans that pass their
    checks, *added* the proposals that the model chooses, which meet neither those nor each other; both are
    ordered by kind and start. Null and empty texts have none. Rows are neither joined nor grouped,
    so repeated rows and ids come out as they are; other columns are not read. Without checked matches
    of both outcomes there is no model, and nothing is added.
    """
    found = stored(candidates(docs), "pii-candidates")
    proposed = (F.col("c.base").isNull() & F.coalesce("c.label", F.lit(True))).alias("proposed")
    cells = found.select(F.explode("found").alias("c")).groupBy("c.cell", "c.label", proposed).agg(F.count("*").alias("n"))
    chosen = _trained(stored(cells, "pii-cells"))
    order = F.array(*[F.lit(k) for k in KINDS])

    def ordered(spans: Column) -> Column:
        ranked = F.transform(spans, lambda c: F.struct(F.array_position(order, c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
        return F.transform(F.array_sort(ranked), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    # Score by cell, negative where it is not chosen.
    scores = F.split(F.lit(",".join(repr(chosen.get(c, -1.0)) for c in range(CELLS))), ",").cast("array<double>")
    scored = F.transform(F.filter("found", lambda c: c["base"].isNull() & F.coalesce(c["label"], F.lit(True))), lambda c: F.struct(
        F.get(scores, c["cell"]).alias("score"), c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
    ))
    picked = _with_apart(found.withColumn("picked", F.filter(scored, lambda c: c["score"] >= 0)), "picked")
    return picked.select(
        "doc_id", ordered(F.filter("found", lambda c: F.coalesce(c["base"], F.lit(False)))).alias("spans"), ordered(F.col("apart")).alias("added"),
    )


PIECE = 4096


def _with_marked(df: DataFrame) -> DataFrame:
    """*df* (text, spans) with ``marked``: the text with a mark in place of each span (start, end, kind), sorted by start.

    A span that begins inside earlier ones has no mark of its own. Pieces of the text are cut once, so
    that no cut walks the whole text.
    """
    cut = df.withColumns({
        "_cut": F.regexp_extract_all("text", F.lit(f"[\\s\\S]{{1,{PIECE}}}"), F.lit(0)), "_ends": F.transform("spans", lambda c: c["end"]),
    })

    def between(low: Column, high: Column) -> Column:
        begin = F.floor(low / PIECE).cast("int")
        near = F.array_join(F.slice("_cut", begin + 1, F.floor(high / PIECE).cast("int") - begin + 1), "")
        return F.when(high > low, F.substring(near, low - begin * PIECE + 1, high - low)).otherwise("")

    parts = running(cut, {"_before": "_ends"}, MAX).withColumn("_parts", F.zip_with("spans", "_before", lambda c, far: F.when(c["start"] >= far, F.concat(
        between(F.greatest(far, F.lit(0)), c["start"]), F.lit("["), F.upper(c["kind"]), F.lit("]"),
    )).otherwise("")))
    end = F.coalesce(F.array_max("_ends"), F.lit(0))
    return parts.withColumn("marked", F.concat(F.array_join("_parts", ""), between(end, F.length("text")))).drop("_cut", "_ends", "_before", "_parts")


def redact(docs: DataFrame) -> DataFrame:
    """*docs* (doc_id unique) with ``redacted``: the text with a mark of its kind in place of each span.

    A null text stays null. The user's other columns, whatever their names, are returned as they are.
    """
    sorted_spans = F.array_sort(F.transform(F.concat("spans", "added"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    spans = pii_spans(docs.where("doc_id is not null")).select(F.col("doc_id").alias("key"), sorted_spans.alias("spans"))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "redacted"]).alias("row"), F.col("doc_id").alias("id"), "text")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    joined = rows.join(spans, F.col("id") == F.col("key"), "left").select("row", "text", F.coalesce("spans", none).alias("spans"))
    return _with_marked(joined).select("row.*", F.col("marked").alias("redacted"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of *docs*."""
    found = pii_spans(docs)
    counts = [F.size(F.filter(F.transform("spans", lambda c: c["kind"]), lambda kind: kind == F.lit(k))).cast("long").alias(f"n_{k}") for k in BASE]
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.transform(F.concat("spans", "added"), lambda c: F.struct(F.array_position(order, c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("spans")), 256).alias("base_sha256"), span_text(F.array_sort(ranked)).alias("spans"))

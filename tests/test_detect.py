"""Detection, scoring, folding and evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from dataveil.functions import detect
from dataveil.functions.synthetic import LOCALES, labelled_rows
from dataveil.functions.vocab import COLUMN_NAMES, LABELS
from dataveil.operators import classify, evaluate, sampling, training

# Known columns and values with their label.
KNOWN = """
ssn|123-45-6789|SSN
social_security_number|001-02-0003|SSN
num_seguro_social|456-78-9012|SSN
cpf|123.456.789-09|SSN
numero_cpf|987.654.321-00|SSN
curp|BADD110313HCMLNS09|SSN
credit_card|4532015112830366|CREDIT_CARD
card_number|4111 1111 1111 1111|CREDIT_CARD
cc_number|5500005555555559|CREDIT_CARD
numero_tarjeta|378282246310005|CREDIT_CARD
numero_cartao|6011111111111117|CREDIT_CARD
email|alice@example.com|EMAIL
correo|usuario@dominio.com.mx|EMAIL
email_address|joao.silva@empresa.com.br|EMAIL
phone|+1-800-555-0199|PHONE
telefone|+55 11 91234-5678|PHONE
celular|+52 55 1234 5678|PHONE
full_name|María García López|FULL_NAME
nome|João da Silva|FULL_NAME
customer_name|John Michael Smith|FULL_NAME
date_of_birth|1990-07-14|DATE_OF_BIRTH
data_nascimento|14/07/1990|DATE_OF_BIRTH
fecha_nacimiento|14-07-1990|DATE_OF_BIRTH
address|123 Main St, Springfield, IL 62701|ADDRESS
endereco|Rua das Flores, 42, São Paulo, SP|ADDRESS
direccion|Calle Insurgentes 500, CDMX|ADDRESS
iban|GB29NWBK60161331926819|BANK_ACCOUNT
conta_bancaria|0001-12345678-9|BANK_ACCOUNT
bank_account|021000021/1234567890|BANK_ACCOUNT
passport_number|A12345678|PASSPORT
numero_pasaporte|AB1234567|PASSPORT
numero_passaporte|AB1234567|PASSPORT
product_id|SKU-0042|NONE
status|active|NONE
price|99.99|NONE
quantity|3|NONE
country_code|BRA|NONE
"""


@pytest.fixture(scope="module")
def known(spark):
    rows = [tuple(line.split("|")) for line in KNOWN.strip().splitlines()]
    return spark.createDataFrame(rows, "column_name string, value string, expected string")


def test_known_rows(spark, known):
    scored = detect.with_top_label(detect.with_scores(known))
    row = evaluate.fixture_scores(scored).first()
    assert (row["fixture_total"], row["fixture_correct"], row["fixture_accuracy"]) == (37, 37, 1.0)
    sure = scored.where((F.col("expected") != "NONE") & ~detect.is_flagged(F.col("label"), F.col("score")))
    assert sure.count() == 0
    assert scored.where((F.col("expected") == "NONE")
                        & detect.is_flagged(F.col("label"), F.col("score"))).count() == 0


def test_scores_are_a_distribution(known):
    scored = detect.with_scores(known)
    for row in scored.collect():
        assert [s["label"] for s in row["scores"]] == LABELS
        assert sum(s["score"] for s in row["scores"]) == pytest.approx(1.0)


def test_gate(spark, known):
    scored = detect.with_top_label(detect.with_scores(known))
    fixtures = evaluate.fixture_scores(scored)
    overall = evaluate.overall_scores(
        evaluate.class_report(scored, truth="expected", predicted="label"))
    assert evaluate.release_gate(overall, fixtures).first()["passed"]
    always = known.withColumn("label", F.lit("EMAIL"))
    bad = evaluate.overall_scores(evaluate.class_report(always, truth="expected", predicted="label"))
    assert not evaluate.release_gate(bad, evaluate.fixture_scores(always)).first()["passed"]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return len(digits) > 1 and total % 10 == 0


def test_luhn(spark):
    rng = random.Random(1)
    cards = ["4111 1111 1111 1111", "4111111111111112", "x", "0", "00", "",
             *["".join(rng.choices("0123456789", k=rng.randint(2, 20))) for _ in range(200)]]
    df = spark.createDataFrame([(c,) for c in cards], "v string")
    for row in df.select("v", detect.luhn_valid(F.col("v")).alias("ok")).collect():
        assert row["ok"] == luhn("".join(c for c in row["v"] if c.isdigit())), row["v"]


def test_labelled_rows(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    rows = labelled_rows(customers, "c_custkey").cache()
    n = customers.count()
    per_label = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    assert per_label == dict.fromkeys(LABELS, n)
    assert {r[0]: r[1] for r in rows.where("label = 'SSN'").groupBy("locale").count().collect()} == {
        x: n // 3 for x in LOCALES}
    cards = rows.where("label = 'CREDIT_CARD'")
    assert cards.where(~detect.luhn_valid(F.col("value"))).count() == 0
    assert {r[0] for r in cards.select(F.length(F.regexp_replace("value", "[^0-9]", ""))).distinct()
            .collect()} == {15, 16}
    for label in LABELS:
        names = {r[0] for r in rows.where(F.col("label") == label).select("column_name").distinct().collect()}
        assert names == set(COLUMN_NAMES[label])
    assert labelled_rows(customers, "c_custkey").exceptAll(rows).count() == 0
    assert labelled_rows(customers, "c_custkey", seed=7).exceptAll(rows).count() > 0


# ---- folding ------------------------------------------------------------------------------------

def closed_form(values):
    """The first of the best personal labels if any scores above the NONE scores ahead of it, else NONE.

    A personal label counts once it beats every score before it that was kept: all NONE scores up to
    the first personal label that does so, and personal labels alone from there on.
    """
    for i, (name, s) in enumerate(values):
        if name != "NONE" and s > max([0.0, *(x for n, x in values[:i] if n == "NONE")]):
            best = max(x for n, x in values[i:] if n != "NONE")
            return next((n, x) for n, x in values[i:] if n != "NONE" and x == best)
    return "NONE", max([0.0, *(x for n, x in values if n == "NONE")])


def test_fold_equals_closed_form(spark):
    rng = random.Random(3)
    groups, rows = {}, []
    for g in range(400):
        groups[f"g{g}"] = [(rng.choice(["NONE", "NONE", "EMAIL", "SSN"]), rng.randint(1, 9) / 10)
                           for _ in range(rng.randint(1, 10))]
        rows += [("t", f"g{g}", i, a, b) for i, (a, b) in enumerate(groups[f"g{g}"])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "table_id string, column_name string, ord int, label string, score double")
    for row in classify.fold_labels(df).collect():
        assert (row["pii_category"], row["confidence"]) == closed_form(groups[row["column_name"]])


def test_high_none_blocks_later_label(spark):
    rows = [("t", "c", 1, "NONE", 0.9), ("t", "c", 2, "EMAIL", 0.8)]
    df = spark.createDataFrame(rows, "table_id string, column_name string, ord int, label string, score double")
    assert classify.fold_labels(df).first()["pii_category"] == "NONE"
    assert classify.any_sensitive(df).first()["pii_category"] == "EMAIL"


# ---- sampling -----------------------------------------------------------------------------------

def test_sample_caps_and_repeats(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    sample = sampling.sample_rows(df, key=["id"])
    assert sample.count() == 1000
    assert sample.exceptAll(sampling.sample_rows(df, key=["id"])).count() == 0
    assert sampling.sample_rows(df, key=["id"], seed=1).exceptAll(sample).count() > 0
    assert sampling.sample_rows(df).count() == 1000
    assert sampling.sample_rows(spark.range(10), key=["id"]).count() == 10


def test_first_values(spark):
    rows = [("t", "email", f"{i:03}", f"v{i}") for i in range(50)]
    rows += [("t", "empty", f"{i:03}", None) for i in range(5)]
    rows += [("t", "few", "001", None), ("t", "few", "002", "x")]
    cells = spark.createDataFrame(rows, "table_id string, column_name string, ord string, value string")
    found = {}
    for r in sampling.first_values(cells).collect():
        found.setdefault(r["column_name"], []).append((r["ord"], r["value"]))
    assert [v for _, v in sorted(found["email"])] == [f"v{i}" for i in range(10)]
    assert found["empty"] == [(1, "")]
    assert found["few"] == [(1, "x")]


def test_strata(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 990, "big").otherwise("small"))
    counts = {r[0]: r[1] for r in sampling.sample_per_stratum(df, ["s"], 20, ["id"])
              .groupBy("s").count().collect()}
    assert counts == {"big": 20, "small": 10}


def test_profile(spark):
    df = spark.createDataFrame([("a", 1, None), (None, 2, 1.5)], "s string, n long, d double")
    rows = [tuple(r) for r in sampling.table_profile(df).orderBy("position").collect()]
    assert rows == [(0, "s", "string", 1, 2), (1, "n", "bigint", 2, 2), (2, "d", "double", 1, 2)]


def test_classification_returns_no_values(spark):
    df = spark.createDataFrame([(i, f"user{i}@example.com", "active") for i in range(30)],
                               "id long, email string, status string")
    cells = sampling.sample_values(df, "t1", ["id"])
    found = classify.classify_columns(cells)
    assert found.columns == ["table_id", "column_name", "pii_category", "confidence", "flagged"]
    labels = {r["column_name"]: (r["pii_category"], r["flagged"]) for r in found.collect()}
    assert labels == {"id": ("NONE", False), "email": ("EMAIL", True), "status": ("NONE", False)}
    rows = classify.finding_rows(found, F.lit("se-1"), F.current_timestamp())
    assert {r["column_id"] for r in rows.collect()} == {"se-1:id", "se-1:email", "se-1:status"}
    assert not any("@" in str(v) for r in rows.collect() for v in r)


def test_empty_column_is_classified(spark):
    df = spark.createDataFrame([(1, None)], "id long, email string")
    found = classify.classify_columns(sampling.sample_values(df, "t", ["id"]))
    assert {r["column_name"]: r["flagged"] for r in found.collect()} == {"id": False, "email": False}


# ---- pluggable and trained models -----------------------------------------------------------------

def _always(label):
    def load():
        return lambda texts: [{label: 0.99, "NONE": 0.01} if label != "NONE" else {"NONE": 0.99}
                              for _ in texts]
    return load


@pytest.mark.parametrize("label", ["EMAIL", "NONE"])
def test_user_model(known, label):
    scored = detect.with_top_label(classify.score_with_model(known, _always(label)))
    rows = scored.collect()
    assert {r["label"] for r in rows} == {label}
    assert all(r["score"] == pytest.approx(0.99) for r in rows)


def test_tie_goes_to_first_label(spark):
    df = spark.createDataFrame([("c", "v")], "column_name string, value string")
    scored = classify.score_with_model(df, lambda: lambda texts: [{"SSN": 0.5, "EMAIL": 0.5}])
    assert detect.with_top_label(scored).first()["label"] == "EMAIL"


def test_macro_scores(spark):
    rows = [("A", "A")] * 8 + [("A", "B")] * 2 + [("B", "B")] * 10
    pred = spark.createDataFrame(rows, "truth string, predicted string")
    report = {r["label"]: r for r in evaluate.class_report(pred, ["A", "B", "C"]).collect()}
    assert report["A"]["precision"] == 1.0 and report["A"]["recall"] == pytest.approx(0.8)
    assert report["C"]["f1"] == 0.0 and report["C"]["support"] == 0
    overall = evaluate.overall_scores(evaluate.class_report(pred, ["A", "B", "C"])).first()
    f1 = [2 * 8 / 18, 2 * 10 / 22]
    assert overall["macro_f1"] == pytest.approx(sum(f1) / 3, abs=1e-4)
    assert overall["macro_f1_present"] == pytest.approx(sum(f1) / 2, abs=1e-4)
    assert overall["accuracy"] == 0.9


def test_threshold_without_confident_rows(spark):
    pred = spark.createDataFrame([("A", "A", 0.5)], "truth string, predicted string, confidence double")
    row = evaluate.threshold_report(pred, ["A"]).first()
    assert (row["confident_samples"], row["coverage"], row["f1"]) == (0, 0.0, 0.0)


def test_registry(spark):
    report = spark.createDataFrame([(0.95, 0.9)], "macro_f1 double, accuracy double")
    row = evaluate.registry_rows(report, "v1", "s3://m/v1", F.current_timestamp()).first()
    assert (row["version"], row["macro_f1"], row["weighted_f1"], row["status"]) == (
        "v1", 0.95, None, "candidate")


def test_trained_model_scores(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet").limit(120)
    rows = labelled_rows(customers, "c_custkey").select("column_name", "value", "label")
    model = training.train(rows, rows, iterations=8, reg_params=(1e-3,))
    assert model.meets_target
    scored = training.predict(model, rows.withColumnRenamed("label", "truth"))
    row = scored.first()
    assert [s["label"] for s in row["scores"]] == LABELS
    assert sum(s["score"] for s in row["scores"]) == pytest.approx(1.0)


def test_features_are_those_of_the_text_stages(spark):
    """Found batch by batch without a string per group of characters, and the same buckets."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler

    given = [("email", "Ana.Lopez1@example.com"), ("n", ""), ("n", None), ("É", "Ça va ñÑ 日本語 😀😀x\ny\r\n z"),
             ("b", "\u0085"), ("c", "ǅÅå٣½"), ("phone", "+52 55 1234 5678")]
    rows = spark.createDataFrame(given, "column_name string, value string")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"[0-9]", "0")
    texts = rows.withColumns({
        "text": classify.model_text(F.col("column_name"), F.col("value")),
        "shape": F.concat(F.lit("^"), F.coalesce(shape, F.lit("")), F.lit("$")),
    })
    stages = []
    for source in ("text", "shape"):
        stages += [
            RegexTokenizer(inputCol=source, outputCol=f"{source}_chars", pattern=".", gaps=False, toLowercase=source == "text"),
            NGram(n=3, inputCol=f"{source}_chars", outputCol=f"{source}_grams"),
            HashingTF(numFeatures=1024, binary=True, inputCol=f"{source}_grams", outputCol=f"{source}_tf"),
        ]
    stages.append(VectorAssembler(inputCols=["text_tf", "shape_tf"], outputCol="features"))
    expected = Pipeline(stages=stages).fit(texts).transform(texts).select("features").collect()
    found = training.featurize(rows).select("features").collect()
    assert [r[0].toArray().tolist() for r in found] == [r[0].toArray().tolist() for r in expected]


def test_labelled_rows_are_spread_and_compiled(spark):
    """Keys of one block go to tasks of a bounded number of keys, and no method is too long to be compiled."""
    from dataveil.functions import synthetic

    keys = spark.range(0, 2 * synthetic.KEYS_PER_TASK + 1, 1, 1).withColumnRenamed("id", "c_custkey")
    assert labelled_rows(keys, "c_custkey").rdd.getNumPartitions() == 3
    few = keys.where("c_custkey < 1000")
    assert labelled_rows(few, "c_custkey").rdd.getNumPartitions() == 1
    spread = labelled_rows(keys, "c_custkey").where("key < 1000")
    assert spread.exceptAll(labelled_rows(few, "c_custkey")).count() == 0 and spread.count() == 10_000
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    codes = debug.codegenStringSeq(labelled_rows(few, "c_custkey")._jdf.queryExecution().executedPlan())
    sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
    assert sizes and max(sizes) < 8000


def test_best_label_without_a_walk(spark):
    """The best label is found by array functions; the first wins a tie, and no scores give an empty label."""
    rows = spark.createDataFrame(
        [(1, [("a", 0.2), ("b", 0.4), ("c", 0.4)]), (2, [("a", None), ("b", 0.1)]), (3, [])],
        "id int, scores array<struct<label: string, score: double>>")
    best = detect.top_label(F.col("scores"))
    assert "lambda" not in str(best)
    found = {r["id"]: (r["b"]["label"], r["b"]["score"]) for r in rows.select("id", best.alias("b")).collect()}
    assert found == {1: ("b", 0.4), 2: ("b", 0.1), 3: ("", -1.0)}

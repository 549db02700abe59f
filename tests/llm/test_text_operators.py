"""Token counts, spelling variants and conversation repair against plain versions."""

import hashlib
import random
import time

import numpy as np
import pytest

from dataveil.llm import conversation_repair, spelling, token_counts
from dataveil.llm.queries import QUERIES
from tests.llm import plain, plain_text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


@pytest.fixture(scope="module")
def docs(spark):
    return plain.awkward_docs(spark)


def counted(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


PARTS = (
    "a e th ing 're 's ' 'll 'l ! ... - ---------- 1 23 \u00e9 \u4e2d\u6587 \U0001f642 <|endoftext|> <|endo |> ABC The = ==== aaaa \x1c \x85".split()
    + [" ", "  ", "\n", "\n\n", "\t", "\u3000", " the"]
)


def test_every_prefix_has_its_own_count(library):
    rng, known = random.Random(1), token_counts._steps(token_counts.VOCABULARY)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(150)]
    signs = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(rng.choice(signs)) if rng.random() < 0.4 else rng.choice(PARTS) for _ in range(12)) for _ in range(40)]
    for text in texts:
        assert [0, *np.cumsum(known.steps(text))] == [counted(library, text[:i]) for i in range(len(text) + 1)], repr(text)


def test_settled_characters_split_like_the_library(library):
    for start in range(0, ord(token_counts.SETTLED), 100):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)}b" for c in range(start, min(start + 100, ord(token_counts.SETTLED))))
        assert [m.span() for m in token_counts.PIECE.finditer(text)] == [x[1] for x in library.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("pattern", ["a", "0 0 0 1 ", "-", "ab@cd.ef ", "abcde", " ", "\n", "\u4e2d\u6587", "<|endoftext|>"])
def test_long_texts_take_linear_time(library, pattern):
    known, times = token_counts._steps(token_counts.VOCABULARY), []
    for size in (100_000, 400_000):
        text = pattern * (size // len(pattern))
        begun = time.process_time()
        steps = known.steps(text)
        times.append(time.process_time() - begun)
        assert len(steps) == len(text)
    assert int(known.steps(pattern * (20_000 // len(pattern))).sum()) == counted(library, pattern * (20_000 // len(pattern)))
    assert times[1] < 12 * times[0] + 2


def test_token_counts_of_awkward_tables(spark, docs, library):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    index = token_counts.prefix_counts(docs, keep_text=True)
    got = sorted(((r.doc_id, r.text, r.n_bytes, r.n_tokens) for r in index.collect()), key=repr)
    assert got == sorted(((d, t, len((t or "").encode()), counted(library, t or "")) for d, t in rows), key=repr)
    assert token_counts.prefix_counts(docs.where("false")).count() == 0
    clash = docs.withColumns({c: docs["lang"] for c in ("steps", "n_bytes", "n_tokens", "fits")})
    assert sorted(map(repr, token_counts.prefix_counts(clash).collect())) == sorted(map(repr, token_counts.prefix_counts(docs).collect()))


def test_truncation_and_budgets(spark, docs, library):
    index = token_counts.prefix_counts(docs, keep_text=True)
    for limit in (0, 3, 17):
        whole = {(r.doc_id, r.text or "") for r in docs.collect()}
        for r in token_counts.truncated(index, limit).collect():
            texts = [t for d, t in whole if d == r.doc_id and t.startswith(r.text or "")]
            assert texts and counted(library, r.text or "") == r.n_tokens <= limit
            longer = [t for t in texts if all(counted(library, t[:i]) > limit for i in range(len(r.text or "") + 1, min(len(t), 300) + 1))]
            assert longer
    got = {r.tokens_at_most: r for r in token_counts.budgets(index, [3, 10**9]).collect()}
    rows = [counted(library, r.text or "") for r in docs.collect()]
    assert (got[10**9].n_docs, got[10**9].n_cut, got[10**9].n_tokens) == (len(rows), 0, sum(rows))
    assert got[3].n_cut == sum(n > 3 for n in rows) and got[3].n_tokens <= 3 * len(rows)
    assert token_counts.budgets(index.where("false"), [3]).count() == 0


def test_token_counts_of_the_corpus(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op11_prefix_token_counts"](spark, SF).collect():
        n = counted(library, texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def word_list(seed, n, signs="aab\u00e9", least=7, most=10):
    rng, found = random.Random(seed), set()
    while len(found) < n:
        found.add("".join(rng.choice(signs) for _ in range(rng.randrange(least, most))))
    return sorted(found)


def test_suffix_order():
    for seed in range(5):
        text = np.array([random.Random(seed).randrange(1, 3) for _ in range(300)] + [0])
        assert list(spelling.suffix_order(text, 2)) == sorted(range(len(text)), key=lambda i: list(text[i:]))


@pytest.mark.parametrize("rightward", [True, False])
def test_searches_find_each_word_once(rightward):
    words = word_list(3, 250)
    want = {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if plain_text.one_apart(x, y)}
    index, size = spelling.Index(words), np.array([len(w) for w in words])
    whole = list(zip(*map(list, index.search(np.arange(len(words)), size * 0, size + 1, rightward))))
    assert len(whole) == len(want) and set(whole) == want
    parts = []
    for low, high in ((0, 2), (2, 3), (3, 6), (6, 99)):
        parts += list(zip(*map(list, index.search(np.arange(len(words)), np.full(len(words), low), np.minimum(high, size + 1), rightward))))
    assert len(parts) == len(want) and set(parts) == want


def found_variants(df, **sizes):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **sizes).collect()}


@pytest.mark.parametrize("sizes", [{}, {"group": 40, "symbols": 500}, {"group": 3, "symbols": 100}])
def test_variants_in_blocks_and_hot_halves(spark, sizes):
    rng = random.Random(2)
    counts = {w: rng.choice([2, 3, 25, 400, 5000]) for w in word_list(5, 400)}
    counts |= {"w" * 300: 20, "w" * 299: 2, "w" * 301: 2}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found_variants(df, **sizes) == plain_text.variants(counts)
    assert spelling.variants(df.where("false"), **sizes).count() == 0


def test_forms_are_followed_to_their_root(spark):
    counts = {"aaaaaaa": 2, "baaaaaa": 20, "bbaaaaa": 200, "bbbaaaa": 2000, "ccccccc": 5, "cccccc": 90}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found_variants(df)
    assert got["aaaaaaa"][1] == got["bbaaaaa"][1] == got["bbbaaaa"][1] == "bbbaaaa" and got["ccccccc"] == (None, "ccccccc", 5, 0, None) and "cccccc" not in got


def test_spelling_of_awkward_tables_and_the_corpus(spark, docs):
    twice = docs.unionByName(docs)
    for table in (docs, twice, docs.withColumns({c: docs["lang"] for c in ("word", "n", "run", "id", "h")})):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        assert {r.word: r.n for r in spelling.word_counts(table).collect()} == plain_text.word_counts(rows)
    assert spelling.word_counts(docs.where("false")).count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op12_fm_index_spelling"](spark, SF).collect()}
    assert got == plain_text.variants(plain_text.word_counts(rows))


def awkward_turns(spark, seed=5, sizes=(0, 1, 2, 3, 5, 9, 20, 150)):
    """Null ids, turns, roles and texts, tied and repeated turns, roles of no known initial, empty and blank texts."""
    rng, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    for conv in (None, *range(50)):
        for t in range(rng.choice(sizes)):
            text = rng.choice(["Hi there.", "ok", "", "  ", "What? ", "a.b", "Yes!\n", None, "x" * rng.randrange(3) + "."])
            rows.append((conv, rng.choice([t, t, t, t // 2, None]), rng.choice(roles), text))
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def digests(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("block", [4096, 64, 8, 1])
def test_conversations_whole_and_in_blocks(spark, block):
    rows, df = awkward_turns(spark)
    want = plain_text.repaired(plain_text.damaged(rows), {r[0] for r in rows})
    broken = conversation_repair.damaged(df)
    assert digests(conversation_repair.repair_digest(broken, block=block)) == want
    turns = conversation_repair.repaired_turns(broken, block=block).collect()
    for conv, digest in want.items():
        own = sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.place)
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == digest[-1]
        assert "".join(t.edit for t in own) == digest[-2].replace("D", "")


def test_one_conversation_of_many_equal_rows(spark):
    rows = [(1, None, "user", "Same text.")] * 700 + [(1, 5, "assistant", "Fine.")] * 300 + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = plain_text.repaired(rows, {1, 2})
    assert digests(conversation_repair.repair_digest(df, block=64)) == digests(conversation_repair.repair_digest(df)) == want


def test_prices_are_dual_feasible_and_equal_distances():
    rng = random.Random(9)
    for _ in range(60):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(0, 12)))
        segment = conversation_repair.Segment(codes, (0, None, None, 0), True)
        for origin in range(4):
            segment.auction(origin)
        for node, arcs in enumerate(segment.arcs):
            assert all(segment.price[node] <= cost + segment.price[to] for _, cost, to in arcs)
        cuts = conversation_repair.distances(codes)
        assert segment.price[0] == min(m + e for m, e in zip(cuts[:4], (0, 4, 2, 0)) if m is not None)


def test_conversations_of_awkward_tables_and_the_corpus(spark):
    rows, df = awkward_turns(spark, 8, (0, 2, 4))
    clash = df.withColumns({c: df["role"] for c in ("seq", "block", "code", "digest", "letters", "n", "long_id", "copy", "fault")})
    assert digests(conversation_repair.repair_digest(conversation_repair.damaged(clash), block=2)) == plain_text.repaired(plain_text.damaged(rows), {r[0] for r in rows})
    assert digests(conversation_repair.repair_digest(clash.repartition(7))) == plain_text.repaired([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows], {r[0] for r in rows})
    assert conversation_repair.repair_digest(conversation_repair.damaged(df.where("false"))).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digests(QUERIES["op13_auction_conversation_repair"](spark, SF)) == plain_text.repaired(plain_text.damaged(rows), {r[0] for r in rows})

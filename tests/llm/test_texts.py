import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfold.llm import abuse
from nearfold.llm.encoding import TOKENIZERS, Encoder, Vocabulary, decoded, token_counts, token_ids
from nearfold.llm.packing import configurations, packed_items, plan_small

tokenizers = pytest.importorskip("tokenizers")
PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(PATH))


TEXTS = [
    None, "", " ", "\n\n \t", "Hello world's  end", "<|endoftext|>", "Привіт, світе! ї", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語テキスト", "🎬🎞️👍🏽", "é​­",
    "x" * 3000, "word " * 20000, "\r\n".join(["line 1234567"] * 50), "ñandú über straße", "a'b'll 're",
]


def test_ids_equal_the_library(spark, library):
    rows = [(i, t, "clash", [1]) for i, t in enumerate(TEXTS)] + [(0, None, "", []), (None, "no id", "", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids array<int>")
    got = token_ids(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids
        assert decoded(r.ids) == text
    assert {r.doc_id: r.tokens for r in token_counts(df).collect()}[4] == len(library.encode(TEXTS[4]).ids)
    assert token_ids(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(encoder, library, texts):
    got = [(ids, sizes) for ids, sizes in encoder.encode(texts)]
    flat = [list(map(int, x)) for ids, sizes in got for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []
    assert flat == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, sizes, capacity):
    bins, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            bins.setdefault(r.container, []).append((r.offset, r.tokens))
    assert {k: sum(p.tokens for p in v) for k, v in pieces.items()} == sizes
    for k, v in pieces.items():
        assert len(v) == max(1, -(-sizes[k] // capacity)) and sorted(p.start for p in v) == [i * capacity for i in range(len(v))]
        assert all((p.container is None) == (sizes[k] == 0) for p in v)
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    return len(bins)


def first_fit(sizes, capacity):
    """Containers that first-fit decreasing opens."""
    pieces = sorted((n for size in sizes for n in [capacity] * (size // capacity) + [size % capacity] if n), reverse=True)
    rooms = []
    for n in pieces:
        for i, room in enumerate(rooms):
            if room >= n:
                rooms[i] -= n
                break
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("kind", ["mixed", "hot", "large", "small", "halves"])
def test_packing(spark, kind):
    rng = random.Random(3)
    draw = {
        "mixed": lambda: int(min(9000, rng.lognormvariate(5.5, 1.3))), "hot": lambda: 700 if rng.random() < 0.4 else rng.randrange(1, 2500),
        "large": lambda: rng.randrange(600, 1100), "small": lambda: rng.randrange(1, 40), "halves": lambda: rng.choice([1024, 1025, 2048, 4096, 1]),
    }[kind]
    sizes = {i: draw() for i in range(1500)} | {5000: 0, 5001: 2048, 5002: 100_000}
    df = spark.createDataFrame([(k, n, 1, 2) for k, n in sizes.items()], "doc_id long, tokens long, container int, piece int")
    used = check_packing(packed_items(df, "doc_id", "tokens").collect(), sizes, 2048)
    assert used <= first_fit(sizes.values(), 2048) * 1.02 + 2


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, tokens long")
    assert [(r.doc_id, r.container, r.tokens) for r in packed_items(df, "doc_id", "tokens").orderBy("doc_id").collect()] == [(1, None, 0), (2, None, 0)]
    assert packed_items(df.where("false"), "doc_id", "tokens").count() == 0
    same = spark.createDataFrame([(1, 10), (1, 10)], "doc_id long, tokens long")
    assert packed_items(same, "doc_id", "tokens", 16).select("container").distinct().count() == 2


def test_configurations_hold_everything():
    rng = random.Random(8)
    sizes = np.array(sorted(rng.sample(range(260, 2048), 30), reverse=True))
    counts = np.array([rng.randrange(1, 5000) for _ in sizes])
    plan = configurations(sizes, counts, 2048)
    assert (sum(c * n for c, n in plan) == counts).all() and all((c * sizes).sum() <= 2048 for c, _ in plan)
    runs, fresh = plan_small({3: 10, 2: 1}, {5: 2}, 10)
    assert fresh == 3 and runs[0].tolist() == [0, 5, 0, 1]


GOOD = ["the cover of {n} was {a}", "in {n} the captain finds a {a} letter", "please keep the larger file {n}", "posts with the word '{b}' are removed", "this {a} disc took me an hour"]
BAD = ["you are a {a} {b}", "shut up {b}, nobody asked for {n}", "all of them are {b} and must go", "i will find you {b}"]
WORDS = {"a": ["slow", "dull", "bright", "old", "warm"], "b": ["zorg", "blarf", "snivel", "grubb"], "n": ["Kemora", "Tulova", "Bisado", "Pareno"]}


def make_text(rng, templates, n):
    return ". ".join(rng.choice(templates).format(**{k: rng.choice(v) for k, v in WORDS.items()}) for _ in range(n)) + "."


def make_corpus(seed, n):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        bad = rng.random() < 0.15
        text = make_text(rng, GOOD, rng.randrange(1, 5)) + (" " + make_text(rng, BAD, 1) if bad else "")
        docs.append((i, f"s{i % 3}", text))
        truth[i] = bad
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = make_corpus(5, 900)
    rng = random.Random(6)
    labels = [(i, int(truth[i] != (rng.random() < 0.08))) for i in range(450) for _ in range(rng.randrange(1, 4))] + [(3, None), (None, 1), (99999, 1)]
    docs += [(2000, "s0", None), (2001, "s0", ""), (2002, None, " \n "), (2003, "s1", "the cover of Kemora was slow. " * 3000 + "you are a dull bla­rf")]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, source string, text string, score double")
    scores = abuse.scored_documents(frame, spark.createDataFrame(labels, "doc_id long, abusive int"))
    got = {r.doc_id: r.score for r in scores.collect()}
    held = range(450, 900)
    hits, found, real = sum(got[i] >= 0.5 and truth[i] for i in held), sum(got[i] >= 0.5 for i in held), sum(truth[i] for i in held)
    assert hits / found > 0.95 and hits / real > 0.95
    assert got[2000] == got[2001] == got[2002] == 0.0 and got[2003] >= 0.5 and len(got) == len(docs)
    rates = {r.source: r for r in abuse.source_rates(scores).collect()}
    assert sum(r.documents for r in rates.values()) == len(docs) and rates["s1"].rate == rates["s1"].abusive / rates["s1"].documents
    assert abs(rates["s1"].mean_score - statistics.mean(got[d[0]] for d in docs if d[1] == "s1")) < 1e-9


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "s", "text"), (1, "s", "text"), (2, None, None)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, abusive int")
    assert [r.score for r in abuse.scored_documents(docs, labels).collect()] == [0.0] * 3
    assert [r.score for r in abuse.scored_documents(docs, labels.where("false")).collect()] == [0.0] * 3
    assert abuse.scored_documents(docs.where("false"), labels).count() == 0


def test_spelling():
    assert abuse.spelt("juump") == abuse.spelt("jump") and abuse.spelt("1d10t")[0] == abuse.spelt("idiot")[0]
    assert abuse.spelt("idoit")[1] == abuse.spelt("idiot")[1] and abuse.spelt("mor**")[1] == "*" and abuse.spelt("1984") == ("0", "0")
    words = abuse.Features().segments("You A r s c h here. crе­tin!\nTwo")
    assert words == [["you", "arsch", "here"], ["cretin"], ["two"]]

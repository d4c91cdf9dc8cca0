"""Reversed search against a plain scoring of every document for every item."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, ts) for d, ts in held if ts]
    n, total = len(held), sum(len(ts) for _, ts in held)
    df = {}
    for _, ts in held:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        rows = []
        for d, ts in held:
            m, s = 10 + 90 * len(ts) * n // total, 0
            for t in wanted & set(ts):
                tf = ts.count(t)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf // (1000 * tf + 8 * m))
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k, parts=3):
    d = spark.createDataFrame(docs, DOCS).repartition(parts)
    return sorted((tuple(r) for r in lexical.search(d, spark.createDataFrame(items, ITEMS), k).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma7", "été", "Straße", "数学", "x", "the", "The", "of", "\x80z", "7"] + [f"w{i}" for i in range(40)]
    glue = [" ", "\n", "-", ", ", "_", "\x00", "@", "`", "{", "\x7f", "/"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(glue) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(120)]
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(7, docs[8][1]), (7, docs[8][1]), (None, docs[3][1]), (None, text(9))]
    docs += [(900, None), (901, ""), (902, " \n--"), (903, text(20_000)), (904, "q" * 100_000)]
    items = [(i, text(12)) for i in range(15)] + [(3, "alpha w1"), (3, "w2"), (20, ""), (21, None), (22, "unseen zzz"), (None, "alpha the"),
                                                 (23, "the"), (24, "q" * 100_000)]
    return docs, items


def test_scores_and_ranks(spark, corpus):
    assert found(spark, *corpus, 10) == brute(*corpus, 10)
    assert found(spark, *corpus, 1, parts=1) == brute(*corpus, 1)


def test_items_in_several_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 2_000)
    assert found(spark, *corpus, 4) == brute(*corpus, 4)


def test_wide_items_meet_in_a_join(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "WIDE_TERMS", 8)
    assert found(spark, *corpus, 5) == brute(*corpus, 5)


def test_texts_cut_into_pieces(spark, corpus, monkeypatch):
    for piece in (1, 7, 64):
        monkeypatch.setattr(lexical, "PIECE", piece)
        for _, t in corpus[0][:60]:
            assert [x.decode() for p in lexical._pieces((t or "").encode()) for x in p] == terms(t)


def test_no_rows_and_clashing_columns(spark, corpus):
    docs, items = (spark.createDataFrame(r, s) for r, s in zip(corpus, (DOCS, ITEMS)))
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.where("doc_id = 902"), items).collect() == []
    extra = {c: F.lit("mine") for c in ("item", "score", "rank", "term", "n", "tf", "h", "_i")}
    got = lexical.search(docs.withColumns(extra), items.withColumns(extra), 3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(*corpus, 3)

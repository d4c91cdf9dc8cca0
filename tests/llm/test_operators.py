"""The numbered operators against brute force on small tables."""

import hashlib
import html
import random
import re
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import connect, difference, duck_result, spark_result
from tokenizers import Tokenizer

from pulsegrid.llm import ann, bpe, html_content, mixing, pii, quality_rules, repeats, sharding, simhash, token_counts
from pulsegrid.llm.components import components
from pulsegrid.llm.registry import load_all

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert difference(spark_result(QUERIES[name](spark, SF)), duck_result(connect(SF), SQL[name])) is None


def test_every_number_has_a_query():
    assert {int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")} == set(range(1, 14))
    assert "pipeline" in QUERIES


# --- repeats

def brute_repeats(docs, length):
    seen, out = set(), {}
    for key, b in sorted(docs.items()):
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j:j + length]
            if w in seen:
                gone[j:j + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 20_000])
def test_repeats(spark, texts, hot):
    rng = random.Random(4)
    docs = dict(texts)
    at = max(docs) + 1
    for i in range(40):  # passages at all alignments, periodic texts, and edits close to the window length
        base = docs[rng.choice(list(texts))][:600]
        docs[at + i] = "".join(rng.choice("abc") for _ in range(i)) + base[rng.randint(0, 80):][:rng.randint(90, 330)] + "ab" * rng.randint(0, 90)
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(d, 100, hot_rows=hot).collect()}
    assert got == brute_repeats({k: t.encode() for k, t in docs.items()}, 100)


def test_anchors_cut_long_texts(monkeypatch):
    b = random.Random(1).randbytes(5000) * 2
    whole = {(p - lo + i, p) for h, ps, los, his in repeats.anchors(b, 100) for p, lo, hi in zip(ps.tolist(), los.tolist(), his.tolist()) for i in range(lo - hi + 1)}
    monkeypatch.setattr(repeats, "PIECE", 700)
    cut = {(p - lo + i, p) for h, ps, los, his in repeats.anchors(b, 100) for p, lo, hi in zip(ps.tolist(), los.tolist(), his.tolist()) for i in range(lo - hi + 1)}
    assert cut == whole and len(whole) == len(b) - 99


def test_repeats_of_shared_ids(spark):
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefgh ") for _ in range(400))
    d = spark.createDataFrame([(1, t), (1, t), (1, "q" + t), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(d, 100).collect())
    assert got[0][1:] == got[1][1:] and got[3] == (2, 400, 400)
    # one of the two texts of id 1 is whole, the other loses what they share
    assert sorted([got[0][2], got[2][2]]) in ([0, 400],)


# --- tokens

def test_bpe_equals_library(texts):
    rng = random.Random(7)
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    odd = ["", "a", " a ", "  a  b", "a  b", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "a" * 5000, " \n\n b", "it's WE'LL 12²½ 🙂"]
    odd += ["".join(rng.choice(every) for _ in range(80)) for _ in range(60)]
    texts = [*texts.values(), *odd]
    enc, lib = bpe.Encoder(bpe.Merges(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    for t, runs in zip(texts, enc.encode(texts)):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert ",".join(runs) == ",".join(map(str, ids))
        assert enc.decode(runs) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, texts):
    lib = Tokenizer.from_file(VOCABULARY)
    for r in QUERIES["op10_segment_tree_bpe"](spark, SF).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def brute_pieces(word, initial, going_on):
    n = i = 0
    while i < len(word):
        among = initial if i == 0 else going_on
        j = next((j for j in range(len(word), i, -1) if word[i:j] in among), None)
        if j is None:
            return 1, True
        n, i = n + 1, j
    return n, False


def test_automaton_is_greedy():
    rng = random.Random(5)
    for _ in range(30):
        initial = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(6)}
        going_on = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(6)}
        auto = token_counts.Automaton(sorted(initial), sorted(going_on))
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90))) for _ in range(200)]
        n, lost = auto.counts(words)
        assert [(a, b) for a, b in zip(n.tolist(), lost.tolist())] == [brute_pieces(w, initial, going_on) for w in words]


def test_one_very_long_word():
    initial, going_on = token_counts.word_pieces(VOCABULARY)
    auto = token_counts.Automaton(initial, going_on)
    rng = random.Random(6)
    word = b" " + "".join(rng.choice(["ab", "the", "é", "漢", "zq", "11"]) for _ in range(600_000)).encode()
    start = time.perf_counter()
    (n,), (lost,) = auto.counts([word])
    assert time.perf_counter() - start < 30 and not lost
    short = word[:600].decode("utf-8", "ignore").encode()
    assert auto.counts([short])[0][0] == brute_pieces(short, set(initial), set(going_on))[0] < n


def test_token_count_query(spark, texts):
    initial, going_on = (set(x) for x in token_counts.word_pieces(VOCABULARY))
    for r in QUERIES["op2_linear_token_counts"](spark, SF).collect():
        words = texts[r.doc_id].encode().split()
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(brute_pieces(b" " + w, initial, going_on)[0] for w in words), 0)


# --- mixing and sharding

def test_mix_meets_entropy_and_limit(spark):
    rows = [(i, f"s{min(9, i % 40)}" if i % 3 else "s0", "w " * (i % 17 + 1)) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    total = sum(i % 17 + 1 for i in range(6000))
    free = mixing.mix(d, target_entropy=0.95, block_rows=64)
    got = Counter()
    for r in free.groupBy("source").agg({"tokens": "sum"}).collect():
        got[r[0]] = r[1]
    p = np.array(list(got.values())) / sum(got.values())
    assert abs(sum(got.values()) - total) < 0.01 * total
    assert abs(-(p * np.log(p)).sum() / np.log(len(p)) - 0.95) < 0.01
    held = mixing.mix(d, target_entropy=1.0, max_repeat=1.5, block_rows=64)
    assert held.groupBy("doc_id").count().agg({"count": "max"}).first()[0] == 2
    own = Counter(r[1] for r in rows)
    for r in held.groupBy("source").count().collect():
        assert r[1] <= 1.52 * own[r[0]] + 20


def test_mix_permutes_each_epoch(spark):
    d = spark.createDataFrame([(i, "b" if i < 30 else "a", "w") for i in range(900)], "doc_id long, source string, text string")
    got = mixing.mix(d, target_entropy=1.0, block_rows=8).where("source = 'b'").collect()
    runs = {e: [r.doc_id for r in sorted((x for x in got if x.epoch == e), key=lambda x: (x.block_rank, x.draw))] for e in {r.epoch for r in got}}
    assert len(runs) == 15 and sorted(runs[0]) == sorted(runs[1]) == list(range(30)) and runs[0] != runs[1]


def test_shards_do_not_depend_on_the_sample(spark):
    rng = random.Random(3)
    rows = [(i, "same text" if i % 3 == 0 else "x" * rng.randint(0, 300) + str(i % 700)) for i in range(5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    one, many = (sorted(map(tuple, sharding.shard_by_size(d, 8, range_rows=n).collect())) for n in (10**6, 200))
    assert one == many
    by = {}
    for _, size, _, shard, slot in one:
        by.setdefault(shard, []).append((size, slot))
    assert all(sorted(s for _, s in v) == list(range(len(v))) for v in by.values())
    sums = [sum(b for b, _ in v) for v in by.values()]
    assert len(sums) == 8 and max(sums) - min(sums) < 0.1 * sum(sums) / 8


# --- personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_base_spans(texts):
    rng = random.Random(6)
    made = ["".join(rng.choice("ab@.-+1 29(0)%") for _ in range(rng.randint(1, 50))) for _ in range(20_000)]
    for t in [*texts.values(), *made, "4111 1111 1111 1111 +1 (555) 010-9999 1.2.3.4.5.6.7.8 a@b@c.d.e."]:
        assert pii.base_spans(t) == brute_spans(t)


@pytest.mark.parametrize("text,want", [
    ("write jo.doe (at) example (dot) com.", ["email:6:35"]), ("jane at mail dot example dot org ok", ["email:0:32"]),
    ("ｊｏ＠ｅｘａｍｐｌｅ．ｃｏｍ", ["email:0:14"]), ("jоhn@exаmple.com", ["email:0:16"]), ("10[.]0[.]0[.]1", ["ip:0:14"]),
    ("call plus one two three four five five five six six six", ["phone:5:55"]),
    ("four one one one 1111 1111 one one one one", ["card:0:42"]), ("one two three at noon", []), ("look at the dot", []),
    ("jo​hn@example.com", ["email:0:17", "email:3:17"])])
def test_disguises(text, want):
    assert pii._line(pii.spans_of(text)[1]).split(",") == (want or [""])


def test_rewriting_keeps_base_and_is_linear():
    t = "1" * 50_000 + "@" * 20_000 + "+1" * 20_000 + "a" * 50_000 + " one" * 20_000 + " a@b.cc"
    base, every = pii.spans_of(t)
    assert base == brute_spans(t[-8:].rjust(8))[:0] + base and set(base) <= set(every)


# --- pages

def test_article_is_found_on_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    fitted = html_content.weights(pages.where("page_id % 2 = 0"))
    want = {}
    for r in pages.where("page_id % 2 = 1").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in html_content.extract(pages.where("page_id % 2 = 1"), fitted=fitted).collect()}
    assert got == want


def test_boilerplate_inside_and_around():
    page = ("<html><head><title>t</title></head><body><div class='main-menu'>Home</div><div id=content><h1>T &amp; x</h1><p>one   two "
            "<a href=x>three</a> four</p><aside>not this</aside><ul><li>item one</li></ul><p>a &lt; b</p></div><section class='comments'>"
            "<p>nice post</p></section><footer>end</footer></body></html>")
    assert html_content.main_text(page, {}, set()) == "T & x\none two three four\nitem one\na < b"


# --- quality

def test_ablations(spark):
    led = spark.createDataFrame([(0,), (1,), (4,), (5,), (5,), (8,)], "failed_bits long")
    got = {(r.policy, r.rule): (r.n_rejected, r.n_failed_rule, r.n_only_this_rule) for r in quality_rules.ablations(led).collect()}
    assert got["v1", "few_words"] == (5, 3, 1) and got["v1", "symbols"] == (5, 3, 1) and got["base", "few_words"] == (3, 3, 3)


# --- vectors

def test_recall_against_brute_force(spark):
    got = QUERIES["op8_learned_partitions"](spark, "/root/testdata/sf0.1").collect()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        mine = [r for r in got if r.query_id == q]
        assert sorted(r.rank for r in mine) == list(range(1, 21))
        hits += len({r.vec_id for r in mine} & set(ids[np.argsort(-s[list(ids).index(q)])[:20]]))
        total += 20
    assert hits >= 0.9 * total


def test_clustered_vectors_use_few_parts(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    _, router = ann.fit(ann.usable(d), 10, 6000)
    assert router.probes <= router.n_parts // 2
    home = np.bincount(router.home(x), minlength=router.n_parts)
    assert home.max() < 4 * home.mean()
    got = ann.nearest(d, d.where("vec_id % 50 = 0"), 10, block_rows=100).collect()
    hits = 0
    for q in range(0, 6000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:10].tolist()))
    assert hits >= 0.9 * 10 * 120


# --- fingerprints

def brute_fingerprint(t):
    words = t.encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(grams))


def groups_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_query(spark, texts):
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fp)
    root = groups_of(ids, [(a, b) for a in ids for b in ids if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_vptree"](spark, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in ids}


def test_links_over_many_shards(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-2**63, 2**63 - 1, 1500)
    near = [int(np.int64(b)) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for b in np.repeat(base[:300], 3)]
    fps = sorted({*map(int, base), *near})
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.u: r.root for r in components(simhash.links(d, shard_rows=100)).collect()}
    a = np.array(fps, np.int64).view(np.uint64)
    linked = [(fps[i], fps[int(j) + i + 1]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3)]
    want = groups_of(fps, linked)
    assert {f: found.get(f, f) for f in fps} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(1000, 1200)}}


# --- pipeline

def test_pipeline(spark, texts):
    """The whole run against the stages' definitions in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").collect()}
    fp = {i: brute_fingerprint(texts[i]) for i in kept}
    ids = sorted(fp)
    root = groups_of(ids, [(a, b) for a in ids for b in ids if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3])
    clean = {i: pii.redacted(texts[i]) for i in ids if root[i] == i}
    own = docs.where(docs.doc_id.isin(list(clean))).collect()
    rows = [(r.doc_id, r.source, clean[r.doc_id]) for r in own]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), corpus_pipeline.ENTROPY, corpus_pipeline.MAX_REPEAT)
    lib = Tokenizer.from_file(VOCABULARY)
    want = sorted((r.doc_id, lib.encode(clean[r.doc_id], add_special_tokens=False).ids) for r in mixed.select("doc_id").collect())
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
    for _, ids in got[:20]:
        assert "@mail" not in lib.decode(ids)


def test_bpe_keeps_what_comes_back(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    rng = random.Random(3)
    enc, whole = bpe.Encoder(bpe.Merges(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    for turn in range(20):
        texts = [f"the cat's  {rng.random()} of\nit", f"and the cat sat {rng.randrange(10 ** 9)} x{rng.randrange(10 ** 6)} é\t", ""]
        for t, runs in zip(texts, enc.encode(texts)):
            assert ",".join(r for r in runs) == ",".join(map(str, whole.encode(t, add_special_tokens=False).ids))
            assert enc.decode(runs) == t
        if turn:
            assert "cat" in enc.again
    assert "cat" in enc.chunks and len(enc.chunks) + len(enc.pieces) < 120


def test_encoder_remembers_no_run_twice(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    enc = bpe.Encoder(bpe.Merges(VOCABULARY))
    for i in range(12):
        texts = [f"odd{i}x{j} word{i * j}. \x1cedge\x1c and\u00a0more" for j in range(20)]
        for t, runs in zip(texts, enc.encode(texts)):
            assert enc.decode(runs) == enc.decode([",".join(runs)]) == t
    kept = [v for v in vars(enc).values() if isinstance(v, dict)]
    assert len(kept) == 2 and sum(map(len, kept)) < 60 + 20 * 12
    assert enc.decode([]) == ""

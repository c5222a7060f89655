"""The training-data operators against brute force, SQL twins, round trips and odd input."""

import base64
import bisect
import collections
import gzip
import hashlib
import itertools
import os
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import licenses, mixing, mtree, packing, pii, queries, quality, sharding, simhash, token_counts, warc
from tablewright.llm.graph import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
ODD = [(1, None, None, "x"), (2, "", "a", None), (3, "word", "a", "y"), (None, "one two three four", None, "z"),
       (5, "same text here again", "b", "y"), (5, "same text here again", "b", "y"), (6, "q" * 50_000, "é", "y"), (7, "w " * 30_000, "b", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and a clashing extra column."""
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, size string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert rows(got) == sorted(map(tuple, want), key=repr)


@pytest.mark.parametrize("op", [mixing.taken, sharding.shard, simhash.near_duplicates, pii.pii_query, quality.quality_query,
                                lambda d: packing.pack_documents(d, queries.tokenizer_path("word_bpe_49k.json"))])
def test_odd_and_empty_tables(odd, op):
    out = op(odd)
    ids = {r.doc_id for r in out.collect()}
    assert ids == {1, 2, 3, None, 5, 6, 7}
    assert op(odd.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [r.asDict() for r in mixing.taken(docs).collect()]
    text = {r.doc_id: (r.source, len(WORD.findall(r.text))) for r in docs.collect()}
    size, weight = collections.Counter(), {}
    for s, n in text.values():
        size[s] += n
    for i, s in enumerate(sorted(size)):
        weight[s] = (3, 1, 2)[i % 3]
    full: dict = {}
    while True:  # share by weight, fix what overflows, share again
        rest = 1.5 * sum(size.values()) - sum(full.values())
        w = sum(weight[s] for s in size if s not in full)
        over = {s: 2.0 * size[s] for s in size if s not in full and rest * weight[s] / w > 2 * size[s]}
        if not over:
            break
        full.update(over)
    taken = collections.Counter()
    for r in found:
        s, n = text[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, size[s]) and r["taken"] <= 2 * n
        assert r["target"] == pytest.approx(full.get(s, rest * weight[s] / w))
        taken[s] += r["taken"]
    assert all(abs(taken[s] - full.get(s, rest * weight[s] / w)) <= 0.5 for s in size)
    assert rows(mixing.taken(docs)) == rows(mixing.taken(docs.repartition(5)))


def test_schedule_keeps_every_stretch_near_the_weights(spark):
    per = spark.createDataFrame([(0, 3000), (1, 1000), (2, 2000)], "idx int, quota long")
    slots = sorted((r.slot, r.idx) for r in mixing.schedule(spark, per, 10).collect())
    for start in range(0, 540, 30):
        part = collections.Counter(i for s, i in slots if start <= s < start + 60)
        assert abs(part[0] - 30) <= 4 and abs(part[1] - 10) <= 4 and abs(part[2] - 20) <= 4


def test_sharding_is_minimax_and_keeps_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.read.parquet(f"{SF}/documents.parquet").limit(40))
    got = sharding.shard(docs, 8).toPandas()
    groups = docs.select(sharding.text_key(F.col("text")).alias("h"), (F.octet_length("text") + 1).alias("b")).groupBy("h").agg(F.sum("b").alias("b"))
    sizes = [r.b for r in groups.orderBy("h").collect()]

    def feasible(capacity):
        n, at = 1, 0
        for s in sizes:
            if at + s > capacity:
                n, at = n + 1, 0
            at += s
        return n <= 8

    low = next(c for c in range(max(max(sizes), sum(sizes) // 8), sum(sizes)) if feasible(c))
    assert got.groupby("shard")["size"].sum().max() == low
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    text = docs.limit(1).collect()[0]
    assert zlib.crc32(text.text.encode()) == got[got.doc_id == text.doc_id].text_crc32.iloc[0]


@pytest.mark.parametrize("hot", [(3,), (9, 10, 11), (1.02,), (8, 8.01)])
def test_sharding_with_large_groups_refines_few_ranges(spark, monkeypatch, hot):
    n, mean = 150_000, 100
    sizes = F.when(F.col("id") < 0, 0)
    for i, part in enumerate(hot):  # group i holds a share of 1 / part of all bytes
        sizes = sizes.when(F.col("id") == i * 40_000 + 7, F.lit(int(n * mean / part)))
    groups = spark.range(n).select(F.xxhash64("id").alias("h"), sizes.otherwise(50 + F.col("id") % 101).cast("long").alias("bytes")).cache()
    found, plain = [], sharding._cells
    monkeypatch.setattr(sharding, "_cells", lambda *a: found.append(plain(*a)) or found[-1])
    bounds = sharding.minimax_cuts(groups, 8)
    assert sum(map(len, found)) < 40_000
    pairs = sorted(map(tuple, groups.collect()))
    capacity, high = max(b for _, b in pairs), sum(b for _, b in pairs)

    def cuts(capacity):
        out, at = [], 0
        for i, (_, b) in enumerate(pairs):
            if at + b > capacity:
                out.append(pairs[i - 1][0])
                at = 0
            at += b
        return out

    while capacity < high:
        mid = (capacity + high) // 2
        capacity, high = (capacity, mid) if len(cuts(mid)) < 8 else (mid + 1, high)
    keys, want = [h for h, _ in pairs], cuts(capacity)
    assert [bisect.bisect(keys, b) for b in bounds[:len(want)]] == [bisect.bisect(keys, w) for w in want]


def test_license_families_and_unknown(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licenses.train(docs, max_negatives=300, features=1 << 12)
    held = [("cc-by-nc", "All text here is licensed under CC BY-NC 4.0."), ("mit", "Code released under the MIT License."),
            ("apache", "This project is licensed under the Apache License, Version 2.0."),
            ("gpl", "You can use this work under the GNU General Public License, version 3."), (None, "He sat by the river and read.")]
    test = spark.createDataFrame([(i, "plain first line\n" + t) for i, (_, t) in enumerate(held)], "doc_id long, text string")
    found = {(r.doc_id, r.paragraph): r.family for r in licenses.scan(test, model).collect()}
    assert found == {(i, 1): f for i, (f, _) in enumerate(held) if f}
    odd = spark.createDataFrame(ODD, "doc_id long, text string, source string, size string")
    assert licenses.scan(odd, model).count() == 0 and licenses.scan(odd.limit(0), model).count() == 0


def brute_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(points, close):
    label = list(range(len(points)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(points)), 2):
        if close(points[i], points[j]):
            label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(points))]


def test_covering_masks_cover_every_pair_of_bits():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(2)]
    assert len(masks) == 7
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


@pytest.mark.parametrize("small", [2, 16])
def test_links_connect_what_all_pairs_connect(spark, small):
    rng, points = random.Random(4), set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            points.add(x - (1 << 64) if x >> 63 else x)
    points = sorted(points)
    want = components(points, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    got = simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"), 2, small)
    label = {r.vertex: r.label for r in connected_components(got).collect()}
    assert [label.get(p, p) for p in points] == [points[i] for i in want]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.vertex: r.label for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_simhash_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    want = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op4_simhash_near_dedup"](spark, SF).collect()}
    assert got == {d.doc_id: (f"{f:016x}", docs[w].doc_id) for d, f, w in zip(docs, fps, want, strict=True)}


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            d = [int(c) for c in re.findall("[0-9]", m[0])]
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(3)
    for alphabet in ("ab1 2.3@-+%(0)9 \n4é.", "12.+ 3-4@a", "0123456789 -"):
        for _ in range(2500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(t) == plain_spans(t)


def test_personal_data_is_discovered_by_context_and_masked(spark):
    rng, words = random.Random(5), "alpha beta gamma delta eps zeta eta theta".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lead = {0: "please call +1 (555) 555-{}", 1: "please call +1 (555) 555-{}", 2: "please call 555-100{},", 3: "order number 555-100{}"}
    data = [(i, f"{some(9)} {lead[i % 4].format(1000 + i)} {some(4)}") for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_query(docs).collect()}
    for i, t in data:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        at = t.find("555-100")
        assert got[i].spans == (f"phone:{at}:{at + 11}" if i % 4 == 2 else base)
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(("<PHONE>" in masked[i]) == (i % 4 != 3) and (i % 4 == 3 or "555" not in masked[i]) for i in masked)


def test_glued_contexts_are_counted_where_instances_have_them(spark):
    rng, words = random.Random(6), "alpha beta gamma delta eps zeta eta theta".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lead = ["tel:+1 (555) 555-{}", "tel:+1 (555) 555-{}", "tel:555-{},", "/q?x=1&email=joe{}@x.org", "/q?x=1&email=joe{}@x.org",
            "/q?x=1&email=ann{}[at]x.org", "ref:+1 (555) 555-{}", "ref:word{} ref:more", "ref: word{}", "ref:555-{}"]
    docs = spark.createDataFrame([(i, f"{some(5)} {lead[i % 10].format(1000 + i)} {some(3)}") for i in range(600)], "doc_id long, text string")
    scanned = pii.scan(docs).cache()
    learned = {(r.pattern, r.kind): r.confidence for r in pii.learn(docs, scanned).collect()}
    assert {("tel:", "phone"), ("/q?x=0&email=", "email")} <= set(learned) and all("ref:" not in p for p, _ in learned)
    assert all(0 <= c < 1 for c in learned.values())
    added = {r.doc_id: r.n_added for r in pii.pii_query(docs).collect()}
    assert added == {i: int(i % 10 in (2, 5)) for i in range(600)}
    places = scanned.select(F.explode("found").alias("x")).select("x.kind", F.explode("x.patterns").alias("pattern")).groupBy("pattern", "kind").count()
    counted = places.join(pii.followers(docs, places.select("pattern").distinct()), "pattern", "left")
    assert counted.where("n_all IS NULL OR n_all < count").count() == 0


def test_top_k_with_odd_vectors(spark):
    data = [(0, [1e38, 2.0]), (100, [3e38]), (200, None), (None, [1.0]), (300, []), (7, [float("nan")]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (400, [None])]
    got = mtree.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    assert {r.query_id for r in got} == {0, 100, 300} and [r.vec_id for r in got if r.query_id == 300] == [0, 9, 9, 100]
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_m_tree_search_with_many_equal_vectors():
    rng = np.random.default_rng(1)
    v = np.vstack([np.repeat(rng.integers(-900, 900, (1, 8)), 1500, 0), rng.integers(-900, 900, (700, 8))])
    tree = mtree.MTree(np.arange(len(v)), v)
    for q in (0, 1600):
        s = v @ v[q]
        want = sorted(((-int(s[i]), i) for i in range(len(v)) if i != q))[:10]
        assert sorted((-a, b) for a, b in tree.search(v[q], q, 10, -(1 << 63))) == want


def test_token_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    encode = packing.token_encoder(open(path, encoding="utf-8").read())
    rng = random.Random(2)
    texts = ["", "  ä  don't WE'LL 123 <|startoftext|>ab \x1c\x85z ΣΑΣ İx é", "日本語 한국어 ñ!!! $$$", "a" * 3000]
    texts += ["".join(rng.choice("aB'sredvmtl09!?<|>é Ñßÿ~́\xa0\n\tΣİ$") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        ids = whole.encode(t, add_special_tokens=False).ids
        assert encode(t) == struct.pack(f"<{len(ids)}I", *ids)


def fewest(items, cap):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= cap and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1:]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = random.Random(1)
    for _ in range(600):
        cap = rng.choice([10, 17, 30])
        items = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 9))), reverse=True)
        p = packing._Plan(dict(collections.Counter(items)), cap)
        p.reduce()
        left = [w for w, n in p.left.items() for _ in range(n)]
        assert p.sequences + fewest(left, cap) == fewest(items, cap)


def test_packing_on_documents(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    got = queries.QUERIES["op7_best_fit_packing"](spark, SF).toPandas()
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want.add((r.doc_id, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert set(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert (ends - got.length == got.offset).all() and ends.max() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2


def test_token_counts_equal_the_unigram_tokenizer():
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    def tokenizer(vocab, fallback):
        t = Tokenizer(models.Unigram([(" ", 0.0), *vocab], unk_id=0, byte_fallback=fallback))
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[\\x20\\x09-\\x0D]+"), "removed"),
                                                   pre_tokenizers.Metaspace(prepend_scheme="always")])
        return t

    rng = random.Random(1)
    for _ in range(60):
        pieces = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(8)})
        vocab = [(p, rng.choice([-1.0, -2.0, -0.5, -3.0])) for p in pieces]
        whole, mine = tokenizer(vocab, False), token_counts.Counter(vocab, False)
        for _ in range(20):
            t = "".join(rng.choice("abc ") for _ in range(12))
            assert mine.text(t)[1] == len(whole.encode(t, add_special_tokens=False).ids)
    vocab = token_counts.vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    whole, mine = tokenizer(vocab, True), token_counts.Counter(vocab)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + ["日本 𝔘nicode ▁ ñ\x00 a", "", "a" * 3000]
    assert [mine.text(t)[1] for t in texts] == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_of_odd_rows(odd):
    got = token_counts.token_counts(odd, [("▁", -1.0), ("a", -1.0)])
    assert got.count() == len(ODD) and got.where("doc_id = 1 AND n_tokens = 0 AND n_words = 0").count() == 1


def test_warc_revisits_and_salvage(spark, tmp_path):
    page = "<p>" + "x" * 200
    data = [(3, "http://a/\r\nb", page), (1, None, page), (1, "u", page), (4, "u", None), (5, "u", ""), (None, "u", page), (6, "u", "short"), (7, "v", "short")]
    pages = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, digest int")
    path = str(tmp_path / "w")
    warc.write_archive(pages.coalesce(1), path)
    got = warc.read_archive(spark, path).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(data)
    kinds = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got}
    assert kinds == {(3, "revisit", 1, 203), (1, "response", None, 203), (4, "response", None, 0), (5, "response", None, 0),
                     (None, "response", None, 203), (6, "response", None, 5), (7, "response", None, 5)}
    assert warc.warc_query(pages.limit(0)).count() == 0
    raw = b"".join(open(tmp_path / "w" / f, "rb").read() for f in sorted(os.listdir(path)) if f.startswith("part"))
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == len(data)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_everything_around_damage(packed):
    records = [warc.build_record(i, "u", f"page {i} ".encode() * 30, hashlib.sha256(f"page {i} ".encode() * 30).hexdigest()) for i in range(40)]
    parts = [warc.gzip_member(r) if packed else r for r in records]
    starts = [sum(map(len, parts[:i])) for i in range(40)]
    data = bytearray(b"".join(parts))
    for i in (3, 10, 11, 39):
        data[starts[i] + len(parts[i]) // 2] ^= 0x55
    del data[starts[20] + 5:starts[20] + 40]
    found = list(warc.salvage(bytes(data)))
    assert [int(x[3]["warc-record-id"][10:-1]) for x in found if x[0] == "record"] == [i for i in range(40) if i not in (3, 10, 11, 20, 39)]
    assert len([x for x in found if x[0] == "gap"]) == 4
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"junk" * 99)] == ["gap"]


def test_salvage_inside_members_long_headers_and_other_digests():
    rng = random.Random(8)
    pages = [rng.randbytes(3000).hex().encode() for _ in range(40)]
    records = [warc.build_record(i, "u", p, hashlib.sha256(p).hexdigest()) for i, p in enumerate(pages)]
    number = lambda x: int(x[3]["warc-record-id"][10:-1])
    bad = [bytes(r[:-9] + b"?" + r[-8:]) if i in (0, 7, 8, 39) else r for i, r in enumerate(records)]
    tail = warc.gzip_member(records[5])
    found = list(warc.salvage(warc.gzip_member(b"".join(bad)) + tail))
    assert [number(x) for x in found if x[0] == "record"] == [*(i for i in range(40) if i not in (0, 7, 8, 39)), 5]
    assert len([x for x in found if x[0] == "gap"]) == 3
    whole = warc.gzip_member(b"".join(records))
    for cut in (whole[:len(whole) // 2], whole[:len(whole) // 2] + b"\xff" * 50 + whole[len(whole) // 2 + 50:]):
        found = list(warc.salvage(cut + tail))
        got = [number(x) for x in found if x[0] == "record"]
        assert got[-1] == 5 and got[:-1] == list(range(len(got) - 1)) and len(got) > 15
        assert len([x for x in found if x[0] == "gap"]) == 1
    long = warc.build_record(1, "u" * (2 << 20), b"page", hashlib.sha256(b"page").hexdigest())
    assert [len(x[3]["warc-target-uri"]) for d in (long, warc.gzip_member(long)) for x in warc.salvage(d)] == [2 << 20] * 2
    for name, text in (("sha1", lambda d: base64.b32encode(d).decode()), ("sha1", bytes.hex), ("md5", bytes.hex)):
        value = f"{name}:{text(hashlib.new(name, b'page').digest())}"
        record = re.sub(rb"(WARC-Block-Digest: )[^\r]*", rb"\1" + value.encode(), warc.build_record(1, "u", b"page", "0"))
        assert [x[0] for x in warc.salvage(record)] == ["record"]
        assert [x[0] for x in warc.salvage(record.replace(b"page\r", b"pbge\r"))] == ["gap"]


def test_pipeline_against_brute_force(spark):
    """Every stage on what the one before kept, checked by its own plain rule."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_query(docs).where("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality rules"](spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    ordered = one.orderBy("doc_id").collect()
    labels = components([brute_fingerprint(r.text) for r in ordered], lambda a, b: (a ^ b).bit_count() <= 2)
    two = stages["simhash near-dedup"](spark, one, SF)
    assert sorted(r.doc_id for r in two.collect()) == sorted({ordered[i].doc_id for i in labels})
    twice = stages["simhash near-dedup"](spark, one.union(one), SF)
    assert rows(twice) == rows(two)
    three = stages["personal data"](spark, two, SF)
    text = {r.doc_id: r.text for r in two.collect()}
    for r in three.collect():
        spans = [{"kind": k, "start": a, "end": b} for k, a, b in plain_spans(text[r.doc_id])]
        assert r.text == pii.masked(text[r.doc_id], spans) and r.n_chars == len(r.text)
    four = stages["source mix"](spark, three, SF)
    copies = {r.doc_id: (r.taken, r.size) for r in mixing.taken(three).collect()}
    got = collections.Counter(r.doc_id for r in four.collect())
    assert all(got[i] == ((2 * t + n) // (2 * n) if n else 1) for i, (t, n) in copies.items())
    five = stages["best-fit packing"](spark, four, SF)
    whole = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    total = sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in four.collect())
    assert five.agg(F.sum("length")).first()[0] == total
    assert corpus_pipeline.run(spark, SF).count() == five.count()

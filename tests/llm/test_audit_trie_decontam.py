"""Filter interaction, conversation trie and decontamination against brute force and odd input."""

import collections
import hashlib
import random
import re
import zlib
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.llm import decontam, interaction, trie

DOC = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def duck(sql, columns, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(f"_{name}", df.toPandas().convert_dtypes())
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    return sorted(map(tuple, c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), key=repr)


# --- filter interaction


def test_intervals_cover_each_order_once():
    for k in (1, 3, 5):
        orders = list(permutations(range(k)))
        got = collections.defaultdict(dict)
        for mask, step, first, end in interaction.intervals(k):
            for r in range(first, end):
                assert r not in got[mask]
                got[mask][r] = step
        for mask in range(1, 1 << k):
            assert got[mask] == {r: next(s for s, f in enumerate(o, 1) if mask >> f & 1) for r, o in enumerate(orders)}


def _audit_tables(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(120)), "short text", "AB CD " * 70, "a b " * 60 + "#", "", None, "x " * 30_000, "é" * 40]
    docs = [(i if i % 11 else None, rng.choice(texts), rng.choice(["en", "de", None, ""]), 1) for i in range(240)] + [(7, texts[1], "en", 1)] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_interaction_on_odd_tables(spark):
    docs, labels = _audit_tables(spark)
    got = interaction.interaction_query(docs, labels)
    assert rows(got) == duck(interaction.SQL, got.columns, documents=docs, labels=labels)
    assert {r.part for r in got.collect()} == {"", "en", "de"}
    assert interaction.interaction_query(docs.limit(0), labels).count() == 0
    without = interaction.interaction_query(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(without) == (0, 0)


def test_text_mask_thresholds():
    words = [f"word{i}" for i in range(100)]
    assert interaction.text_mask(" ".join(words).encode()) == 0
    assert interaction.text_mask(" ".join(words[:99]).encode()) == 1
    assert interaction.text_mask(" ".join(words[:80] + ["word0"] * 20).encode()) == 0
    assert interaction.text_mask(" ".join(words[:79] + ["word0"] * 21).encode()) == 2
    assert interaction.text_mask(b"") == 1
    assert interaction.text_mask("Éé".encode()) == 1 and interaction.text_mask(b"Ab") == 5 and interaction.text_mask(b"|") == 9


# --- conversation trie


def brute_trie(convs):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in convs:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))

    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]

    own = {c: [(r, t) for *_, r, t in sorted(ts, key=lambda x: (x[0], x[1], digest(*x[2:])))] for c, ts in turns.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += own_saved
    ends = {p: hashlib.sha256(",".join(map(str, sorted(c for c in m if paths[c] == p))).encode()).hexdigest() for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends[p]) for p, m in members.items()), key=repr)


CONVS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("segment", "per_shard"), [(32, 40), (3, 60), (1, 400)])
def test_trie_equals_brute_force(spark, segment, per_shard):
    rng = random.Random(segment)
    convs = []
    for c in range(-12, 70):
        if c % 10 == 5:
            continue  # a base that is absent
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 9, 11, 14])):
            convs.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", "bé", None])))
    convs += [(c, t, "user", "same") for c in range(200, 260) for t in range(10)]  # one hot path, but for lent turns
    convs += [(301, 0, "user", "repeat")] * 25 + [(None, 0, "user", "lost")]
    df = spark.createDataFrame(convs, CONVS).withColumn("shard", F.lit("clash"))
    assert rows(trie.prefix_trie(df, segment, per_shard)) == brute_trie(convs)


def test_trie_of_many_equal_turns_and_none(spark):
    convs = [(11, 0, "u", "x")] * 30 + [(12, t, "u", "x") for t in range(12)]
    df = spark.createDataFrame(convs, CONVS)
    saved, trie._COPIES = trie._COPIES, 7
    try:
        assert rows(trie.prefix_trie(df, 4, 3)) == brute_trie(convs)
    finally:
        trie._COPIES = saved
    assert trie.trie_query(df.limit(0)).count() == 0


# --- decontamination


def brute_hits(docs, items, window=10):
    def words(t):
        return DOC.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i:i + k])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i:i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[x]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _corpus(rng, most):
    vocabulary = [f"w{i}" for i in range(9)] + ["É", "über", "x9"]
    items = [(rng.choice([None, *range(40)]), " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 9, 10, 11, 30])))) for _ in range(60)]
    items += [(50, "of the " * 20), (51, "of the " * 20), (52, ""), (53, None), (54, "-- ,, --")]
    docs = []
    for i in range(80):
        w = rng.choices(vocabulary + ["z"] * most, k=rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            text = (rng.choice(items)[1] or "").upper().split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = text[rng.randrange(len(text) + 1):]
        docs.append((rng.choice([i, i, None]), rng.choice([" ", "-", "\n\t"]).join(w)))
    return docs + [(900, None), (901, ""), (902, "of the " * 9000), (902, "of the " * 9000)], items


@pytest.mark.parametrize(("block_bytes", "block", "chunk"), [(4 << 20, 2, 1 << 22), (1500, 2, 64), (400, 3, 1 << 22), (4 << 20, 1, 16)])
def test_decontamination_equals_brute_force(spark, monkeypatch, block_bytes, block, chunk):
    monkeypatch.setattr(decontam, "_CHUNK", chunk)
    docs, items = _corpus(random.Random(block), 60)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("k", F.lit("x"))
    got = decontam.contamination(d, b, 10, block_bytes, block).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(got) == brute_hits(docs, items)
    if block == 2:
        assert rows(got) == duck(decontam.SQL, got.columns, documents=d, benchmark=b)


def test_decontamination_of_empty_tables(spark):
    docs, items = _corpus(random.Random(1), 60)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contamination_query(d.limit(0), b).count() == 0
    none = decontam.contamination_query(d, b.limit(0))
    assert none.count() == len(docs) and none.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


def test_wu_manber_skips_but_loses_nothing():
    rng = random.Random(3)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(4000)]
    windows = {tuple(words[i:i + 10]): {i} for i in range(100, 3000, 371)}
    s = decontam.WuManber(windows, 10)
    got = {i for i, _ in s.search(words, 0)}
    assert got == {i for i in range(9, 4000) if tuple(words[i - 9:i + 1]) in windows}
    looked = []
    s.shift = type("Counting", (dict,), {"get": lambda self, *a: looked.append(1) or dict.get(self, *a)})(s.shift)
    assert not list(s.search([b"z"] * 9000, 0)) and len(looked) == 999

"""CSV in splits against the one-task reader, dates by their form, clusters by peeling."""

import collections
import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import dates as D
from tablewright.operators import clean as C
from tablewright.operators import components
from tablewright.operators import fuzzy as FZ
from tablewright.operators import profile as P
from tablewright.operators.freq import value_freq
from tablewright.session import staged, staged_if_derived
from tablewright.sources import csvfile
from tablewright.sources import files as FL

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("c", T.IntegerType())])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "64"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _random_csv(rng, n):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["a", "b", "c"])
    for _ in range(n):
        text = ["".join(rng.choice('xé,"\n b') for _ in range(rng.choice([0, 1, 3, 9, 150]))) for _ in range(2)]
        if rng.random() < 0.15:  # quotes where none are due, too few and too many fields
            out.write(rng.choice(['5" pipe,q,1\n', 'a,"b"x,2\n', "one\n", 'p,"q",3,more\n', 'u,v,""\n', 'k,"""",notint\n', "\n"]))
        else:
            w.writerow([*text, rng.choice(["", "7", "-12"])])
    return out.getvalue()


@pytest.mark.parametrize("seed", range(4))
def test_csv_in_splits_equals_the_one_task_reader(spark, tmp_path, tiny_splits, seed):
    rng = random.Random(seed)
    text = _random_csv(rng, 120)
    if seed == 3:
        text += 'last,"never closed\nand on'
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.csv").write_text(text, newline="")
    (tmp_path / "x" / "2.csv").write_text(_random_csv(rng, 9), newline="")
    (tmp_path / "x" / "3.csv").write_text("a,b,c\n", newline="")
    path = str(tmp_path / "x")
    lines = csvfile._lines(spark, path)
    assert lines.rdd.getNumPartitions() > 20
    files = csvfile.CsvFiles(spark, path)
    assert len(files.open) > 3
    options = {"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", **csvfile.QUOTING}
    full = T.StructType([*SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    want = spark.read.options(**options).schema(full).csv(path)
    got = csvfile.read_records(files, SCHEMA, corrupt=True)
    assert rows(got) == rows(want)


def test_csv_of_many_files_and_orders(spark, tmp_path, tiny_splits):
    (tmp_path / "1.csv").write_bytes(b'\xef\xbb\xbfa,b,c\r\n1,"x\r\ny",2\r\n')
    (tmp_path / "2.csv").write_text('c,"b",a\n5,"say ""hi""",4\n\n')
    got = FL.read_table(spark, str(tmp_path), schema=SCHEMA)
    assert rows(got) == [("1", "x\r\ny", 2), ("4", 'say "hi"', 5)]
    inferred = FL.read_table(spark, str(tmp_path / "2.csv"))
    assert inferred.schema.simpleString() == "struct<c:int,b:string,a:int>"
    (tmp_path / "3.csv").write_text("a,b,z\n")
    with pytest.raises(ValueError, match="does not name"):
        FL.read_table(spark, str(tmp_path), schema=SCHEMA)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.csv").write_text('1;"a;b\nc";3\n')
    assert rows(FL.read_table(spark, str(tmp_path / "t"), schema=SCHEMA, header=False, sep=";")) == [("1", "a;b\nc", 3)]


def test_wrong_and_half_wrong_encodings_are_told_apart(spark, tmp_path, tiny_splits):
    lines = ["a,b,c"] + [f"{'é' if i % 2 else 'e'}{i},größe,{i}" for i in range(60)]
    (tmp_path / "latin.csv").write_bytes("\n".join(lines).encode("latin-1"))
    damaged = [x.encode("utf-8") if i % 3 else x.encode("latin-1") for i, x in enumerate(lines)]
    (tmp_path / "damaged.csv").write_bytes(b"\n".join(damaged))
    good, bad, record = FL.read_with_quarantine(spark, str(tmp_path / "latin.csv"), SCHEMA)
    assert good is None and record["stage_failed"] == "csv_read_encoding" and record["encoding"][0]["n_bad"] == 60
    assert record["encoding"][0]["first_bad"] == 6
    good, bad, record = FL.read_with_quarantine(spark, str(tmp_path / "damaged.csv"), SCHEMA)
    assert "stage_failed" not in record and good.count() == 40 and bad.count() == 20
    read = FL.read_table(spark, str(tmp_path / "latin.csv"), schema=SCHEMA, encoding="ISO-8859-1")
    assert read.where("b = 'größe'").count() == 60
    (tmp_path / "u16").mkdir()
    (tmp_path / "u16" / "x.csv").write_bytes("\n".join(lines[:3]).encode("utf-16"))
    assert FL.read_table(spark, str(tmp_path / "u16"), schema=SCHEMA, encoding="UTF-16").where("b = 'größe'").count() == 2
    assert rows(FL.encoding_report(spark, str(tmp_path)).select("n_bad", "wrong_encoding")) == [(20, False), (60, True)]


TOLD = {
    "2024-01-05 10:00": "2024-01-05 10:00:00", "13/02/2024": "2024-02-13 00:00:00", "01/05/2024 10:00:00": "2024-01-05 10:00:00",
    "5 January 2024": "2024-01-05 00:00:00", "20240105": "2024-01-05 00:00:00", "05-Jan-2024": "2024-01-05 00:00:00", "Jan 5 2024": "2024-01-05 00:00:00",
    "2024-01-05T10:00Z": "2024-01-05 10:00:00", "2024-01-05T10:00+0530": "2024-01-05 04:30:00", "2024-01-05 10:00:00 UTC": "2024-01-05 10:00:00",
    "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05 10:00:00", "1/5/2024 9:30 PM": "2024-01-05 21:30:00", "1/5/2024 12:05 a.m.": "2024-01-05 00:05:00",
    "Sept. 5, 2024": "2024-09-05 00:00:00", "1/5/24": "2024-01-05 00:00:00", "1/5/70": "1970-01-05 00:00:00", "2024.01.05": "2024-01-05 00:00:00",
    "2024-Jan-05": "2024-01-05 00:00:00", "  MAY 5, 2024 ": "2024-05-05 00:00:00", "2024-01-05 10:00:00.123456": "2024-01-05 10:00:00.123456",
    "13/13/2024": None, "20241305": None, "2024-1/5": None, "#p,,2024-1-5 ": None, "1/5/2024 13:00 PM": None, "2024-02-30": None, "may": None,
    "5 Janch 2024": None, "12345678": None, "2024": None, "10:00": None, "5 2024": None, "2024-01-05x": None, "x" * 70: None, "": None,
}


def test_dates_of_every_form(spark):
    df = spark.createDataFrame([(k,) for k in TOLD] + [(None,)], "t string")
    got = {r[0]: r[1] for r in df.select("t", D.parse_timestamp("t").cast("string")).collect()}
    assert got == {**TOLD, None: None}
    dashes = spark.createDataFrame([("05-01-2024",), ("05.01.2024",), ("05/01/2024",), ("01-13-2024",)], "t string")
    told = [[str(r[0])[5:10] for r in dashes.select(D.parse_timestamp("t", how)).collect()] for how in (D.BY_COLUMN, D.MONTH_FIRST, D.DAY_FIRST)]
    assert told == [["01-05", "01-05", "05-01", "01-13"], ["05-01", "05-01", "05-01", "01-13"], ["01-05", "01-05", "01-05", "01-13"]]
    day = df.select("t", D.parse_timestamp("t", D.DAY_FIRST).cast("string").alias("d"))
    assert {r.t: r.d for r in day.collect() if r.t in ("1/5/24", "13/02/2024", "01/05/2024 10:00:00")} == {
        "1/5/24": "2024-05-01 00:00:00", "13/02/2024": "2024-02-13 00:00:00", "01/05/2024 10:00:00": "2024-05-01 10:00:00"}


def test_a_column_decides_which_part_is_the_day(spark):
    data = [(i, f"{d:02d}/02/2024", f"02/{d:02d}/2024", "03/04/2024") for i, d in enumerate(range(1, 29))]
    df = spark.createDataFrame(data, "id int, eu string, us string, open string")
    assert D.date_orders(df, ["eu", "us", "open"]) == {"eu": D.DAY_FIRST, "us": D.MONTH_FIRST, "open": D.BY_SEPARATOR}
    out = C.dates_to_epoch(df, ["eu", "us"], fill=None)
    assert out.where("eu <> us").count() == 0
    assert C.drop_date_violations(df, "eu", "us").count() == 28 and C.drop_date_violations(df, "us", "eu").count() == 28
    prof = P.profile(df.drop("id"))
    assert prof.date_formats["eu"] == D.DAY_FIRST and not prof.date_conflicts
    assert D.date_orders(df, ["eu"], D.MONTH_FIRST) == {"eu": D.MONTH_FIRST}


def brute_clusters(values, t):
    norm = {v: v.strip(" ").lower() for v in values}
    taken, out = set(), []
    order = sorted(values)
    for i, v in enumerate(order):
        if v in taken:
            continue
        mine = [w for w in order[i + 1:] if w not in taken and FZ.similarity(norm[v], norm[w], t) is not None]
        taken.update(mine)
        out += [("c", v, m) for m in (v, *mine)] if mine else []
    return sorted(out, key=repr)


def slow_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_similarity_is_the_ratio():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(12))) for _ in range(2))
        for t in (40, 80):
            r = slow_ratio(a, b)
            assert FZ.similarity(a, b, t) == (r if r >= t else None)


@pytest.mark.parametrize(("t", "peel", "fold"), [(80, 6, 2), (60, 1, 2), (92, 2, 2), (80, 1, 10_000)])
def test_clusters_equal_the_greedy_rule(spark, t, peel, fold):
    rng = random.Random(t + peel)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(14)]
    values = set(base) | {" ", "", "A"}
    while len(values) < 90:
        v = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(v) + 1)
            v[at:at + rng.randint(0, 1)] = [rng.choice("abcdA ")]
        values.add("".join(v))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "c string")
    got = FZ.clusters(value_freq(df, ["c"]), t, peel_rounds=peel, fold_values=fold)
    assert rows(got) == brute_clusters(values, t)


def test_values_near_each_other_are_scored_once(spark, monkeypatch):
    n, scored, plain = 4000, [], FZ._scored
    monkeypatch.setattr(FZ, "_scored", lambda pairs, t: scored.append(pairs.count()) or plain(pairs, t))
    df = spark.range(n).select(F.format_string("a long common prefix %05d", "id").alias("c"))
    got = FZ.clusters(value_freq(df, ["c"]), 80, fold_values=10)
    assert got.count() == n and got.select("seed").distinct().count() == 1 and sum(scored) <= 2 * n


@pytest.mark.parametrize(("t", "peel", "block"), [(80, 0, 30), (92, 1, 20)])
def test_blocks_decide_what_peeling_leaves(spark, monkeypatch, t, peel, block):
    monkeypatch.setattr(FZ, "_PAIRS_A_VALUE", 0)
    monkeypatch.setattr(FZ, "_BLOCK_VALUES", block)
    rng = random.Random(t + block)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(14)]
    values = set(base) | {" ", "", "A"} | {f"{rng.choice(base)}{rng.choice('abcdA ')}{rng.choice(base)[:2]}" for _ in range(70)}
    df = spark.createDataFrame([(v, v[::-1]) for v in values], "c string, d string")
    got = FZ.clusters(value_freq(df, ["c", "d"]), t, peel_rounds=peel, fold_values=2)
    both = [(c, *x[1:]) for c, of in (("c", values), ("d", {v[::-1] for v in values})) for x in brute_clusters(of, t)]
    assert rows(got) == sorted(both, key=repr)


def test_ids_with_many_seeds_make_no_pairs(spark, monkeypatch):
    """Peeling takes a seed a round from these values; the pairs of the rest are quadratic."""
    n, scored, plain = 3000, [], FZ._scored
    monkeypatch.setattr(FZ, "_scored", lambda pairs, t: scored.append(pairs.count()) or plain(pairs, t))
    values = [f"Supplier#{i * 7 % 10_000_000:09d}" for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = FZ.clusters(value_freq(df, ["c"]), 80, peel_rounds=1, fold_values=10)
    assert rows(got) == brute_clusters(values, 80)
    assert sum(scored) <= 2 * n


@pytest.mark.parametrize("fold", [10 ** 6, 10])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, fold):
    n = 10_000 if fold > 10 else 40
    steps, plain = collections.Counter(), components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: steps.update([name]) or plain(df, name))

    def r(x):
        return F.struct(F.lit(True).alias("unseen"), F.lit(0).alias("seen"), x.alias("of"))

    a, b = F.format_string("v%06d", "id"), F.format_string("v%06d", F.col("id") + 1)
    pairs = spark.range(n).select(F.lit("c").alias("column"), a.alias("value_a"), b.alias("value_b"), r(a).alias("r_a"), r(b).alias("r_b"))
    got = FZ.greedy_clusters(pairs, fold_pairs=fold)
    want = {(f"v{i:06d}", f"v{i + k:06d}") for i in range(0, n, 2) for k in (0, 1)}
    assert {(x.seed, x.member) for x in got.collect()} == want
    assert steps["labels"] <= 10 and steps["jumps"] <= 30  # the pairs' hashes are in no order


def test_only_derived_inputs_are_staged(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(9).withColumn("v", F.lit("x")).write.parquet(path)
    stored = spark.read.parquet(path)
    assert staged_if_derived(stored.where("id > 2").select("id"), "t") is not None
    assert staged_if_derived(stored, "t") is stored
    derived = stored.distinct()
    assert staged_if_derived(derived, "t") is not derived
    assert rows(staged(derived, "t")) == rows(derived)

"""The library's operators: SQL on the smallest tables, brute force, and rules that must break."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import audit, dedup, geometry, governance, manifest, metrics, ordered, sequences, shapes, similarity, split
from quern.plans.all import ORACLES, QUERIES
from quern.sources import manifests
from quern.streaming import crossing

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*[f"`{c}`" for c in want.columns]).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("threshold", [0, 1, 2, 5, 8])
def test_banded_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(60)]
    codes = {c for b in base for c in (b, b ^ (1 << rng.randrange(64)), b ^ (7 << rng.randrange(60)))} | {0, (1 << 64) - 1}
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    want = {(*sorted((signed(a), signed(b))), (a ^ b).bit_count()) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= threshold}
    got = dedup.near_pairs(spark.createDataFrame([(signed(c),) for c in codes], "code long"), threshold).collect()
    assert {(r.a, r.b, r.dist) for r in got} == want and len(got) == len(want)


def test_content_hash_is_a_tree(spark):
    import hashlib

    rows = [(i % 7, f"ü{i}") for i in range(500)] + [(3, None), (None, "first"), (3, "ü3")]
    df = spark.createDataFrame(rows, "k int, line string").repartition(5)
    lines = [x for _, x in sorted(((-1 if k is None else k, x) for k, x in rows if x is not None))]
    sha = lambda own: hashlib.sha256("\n".join(own).encode()).hexdigest()
    for _ in range(2):
        lines = [sha(lines[i : i + 6]) for i in range(0, len(lines), 6)]
    assert len(lines) > 10
    assert tuple(dedup.content_hash(df, ["k"], F.col("line"), fan=6).first()) == (sha(lines), len(rows))
    assert tuple(dedup.content_hash(df.limit(0), ["k"], F.col("line")).first()) == (None, 0)


def test_metrics_facts(spark):
    p = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2)], "truth int, pred int")
    s = metrics.summary(p).first()
    assert s.accuracy == 0.75 and s.balanced_accuracy == 0.75
    s = metrics.summary(spark.createDataFrame([(1, 3), (2, 2)], "truth int, pred int")).first()
    assert s.macro_f1 == 0.5 and s.macro_f1_all == pytest.approx(1 / 3)


def test_paired_facts(spark):
    d = spark.createDataFrame([("m", x) for x in (0.10, 0.08, 0.06, 0.04, 0.02)], "metric string, d double")
    t, q = metrics.paired(d, ["metric"], "d").first(), metrics.describe(d, ["metric"], "d").first()
    assert t.df == 4 and t.wins == 5 and q.median == pytest.approx(0.06) and q.ci_low > 0
    both = metrics.paired(d, ["metric"], "d").join(metrics.describe(d, ["metric"], "d").select("metric", "ci_low", "ci_high"), "metric")
    assert metrics.verdict(both).first().verdict == "advantage"


def test_text_facts(spark):
    f = lambda value, c: spark.createDataFrame([(value,)], "x string").select(c(F.col("x")).alias("r")).first().r
    assert f("a-b c.", T.normalized_id) == "A_B_C"
    ref = lambda v: f(v, lambda c: T.parse_reference(c, ["PEDT", "PELA"]))
    assert ref("PEDT, I, L. 4") == ("PEDT", "PEDT_I") and ref("PELA, V L. 5") == ("PELA", "PELA_V") and ref("Unknown") == ("", "")
    assert ref("PEDT, I l. 4") == ref("pedt, I L 4") == ("PEDT", "PEDT_I") and ref("PEDT, XL4") == ("PEDT", "PEDT_XL4") and ref("PELA") == ("PELA", "")
    assert f("word_0001_char_01_0905.png", T.filename_identity)[1:3] == ("WORD_0001", "WORD_0001_CHAR_01")
    assert f("WORD_12345_char_1_x.png", T.filename_identity)[1:3] == ("WORD_12345", "WORD_12345_CHAR_01")
    assert f("col_1_p001.png", T.filename_identity)[2:] == ("COL_01_P001", "REFERENCE_CHART_P001")
    assert f("diff_page_39_p001.png", T.filename_identity)[2:] == ("DIFF_PAGE_0039_P001", "DIFF_PAGE_0039")
    assert f("diff_अ_p001.png", T.filename_identity).crop == "DIFF_U0905_P001"
    assert f("diff_x_p1234.png", lambda c: T.filename_identity(c, F.lit("\U0001f600"))).crop == "DIFF_U1F600_P1234"
    assert f("a b/c d e.tar.png", T.safe_stem) == "c_d_e.tar"
    bins = lambda g: [f(n, lambda c, g=g: g(c.cast("int"))) for n in ("1", "2", "9", "10", "20")]
    assert bins(T.frequency_bin_comparison) == bins(T.frequency_bin_strict) == ["one_shot", "2_4", "5_9", "10_19", "20_plus"]
    assert f("0", lambda c: T.frequency_bin_comparison(c.cast("int"))) == "one_shot"
    with pytest.raises(Exception, match="below one"):
        f("0", lambda c: T.frequency_bin_strict(c.cast("int")))
    with pytest.raises(Exception, match="unknown file name"):
        f("other.png", T.filename_identity)
    assert f("किं", T.label_parts) == ("क", "ि", True)
    assert f("x/datasets/a/b.png", T.portable_path) == "datasets/a/b.png" and f("कि", T.label_code) == "U0915_U093F"


def test_router_truth_table(spark):
    rows = [(2, 1, 1, 0.9, True), (3, 1, 16, 0.9, False), (2, 1, 1, 0.1, False)]
    t = spark.createDataFrame(rows, "ta int, da int, shots int, margin double, want boolean")
    got = t.select(similarity.route(F.col("ta"), F.col("da"), F.col("shots"), F.col("margin"), 4, 0.5).alias("r"), "ta", "da", "want").collect()
    assert all((r.r == r.ta) == r.want for r in got)
    p = spark.range(1).select(V.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p")).first().p
    assert p == [0.5, 0.5]


def test_raster_components_touch_diagonally(spark):
    px = [(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 2, 2), (1, 6, 6), (2, 0, 0)]
    got = geometry.raster_components(spark.createDataFrame(px, "image int, y int, x int")).collect()
    assert sorted((r.image, r.area) for r in got) == [(1, 1), (1, 4), (2, 1)]


def test_validator_and_alignment_break(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id int, score double")
    got = {r.rule: r.violations for r in audit.violations(rows, {"range": F.col("score").between(0, 1), "id": F.col("id") > 0}).collect()}
    assert got == {"range": 1, "id": 0}
    assert [r.id for r in audit.misaligned(rows, rows.withColumn("score", F.lit(0.5)), ["id"], ["score"]).collect()] == [2]


def test_greedy_split_keeps_groups_and_classes(spark):
    rng = random.Random(1)
    rows = [(f"g{i}", rng.choice("abc"), rng.randrange(1, 9)) for i in range(60)]
    groups = spark.createDataFrame(rows, "grp string, cls string, n long").groupBy("grp", "cls").agg(F.sum("n").alias("n"))
    got = {r.grp: r.split for r in split.group_split(groups).collect()}
    assert set(got) == {r[0] for r in rows} and set(got.values()) == {"train", "validation", "test"}
    assert {c for g, c, _ in rows if got[g] == "train"} == {"a", "b", "c"}


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p1", "A", "1", "train"), ("p2", "", "2", "train")], "sample_path string, class_label string, class_index string, split string")
    manifests.write_csv(df, f"file://{tmp_path}/m")
    back = manifests.read_csv(spark, f"file://{tmp_path}/m", df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    labels = spark.createDataFrame([("A", 1)], "label string, full_idx int")
    with pytest.raises(ValueError, match="contract"):
        manifests.checked(back, "train", labels)
    assert manifests.checked(back.filter("class_label = 'A'"), "train", labels).count() == 1
    with pytest.raises(ValueError, match="no rows"):
        manifests.write_csv(df.limit(0), f"file://{tmp_path}/n", "raise")


def test_suppression_and_interpolation(spark):
    p = spark.createDataFrame([("a", 1, 5), ("a", 3, 9), ("a", 9, 4), ("b", 1, 1)], "g string, d int, n int")
    assert sorted((r.g, r.d) for r in sequences.suppress(p, ["g"], "d", "n", 4).collect()) == [("a", 3), ("a", 9), ("b", 1)]
    v = spark.createDataFrame([("a", 0, None), ("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("a", 4, None)], "g string, d int, n double")
    assert [r.filled for r in sequences.interpolate(v, ["g"], "d", "n").orderBy("d").collect()] == [1, 1, 2, 3, 3]


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_numbers_and_totals_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randrange(100), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i int, v int").repartition(7)
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    got = {r.i: (r.idx, r.before) for r in ordered.running_total(ordered.number(df, ["x", "i"]), ["x", "i"], "v").collect()}
    assert got == {r[2]: (k + 1, sum(q[3] for q in order[:k])) for k, r in enumerate(order)}
    own = {r.i: r.idx for r in ordered.number_within(df, ["g"], ["x", "i"]).collect()}
    assert own == {r[2]: k + 1 for g in "ab" for k, r in enumerate(q for q in order if q[0] == g)}
    assert ordered.number(df.limit(0), ["x"]).count() == 0


def test_canonical_manifest_inherits_and_raises(spark):
    originals = spark.createDataFrame([("A", "a.png", "h1", 1, None, "INS", "P", "", "C1"), ("B", "b.png", "h2", 2, "", "", "", "W1", "C2")], "class_label string, name string, file_sha256 string, perceptual_hash long, estampage_id string, inscription_id string, page_id string, word_id string, original_crop_id string")
    made = manifest.provenance(spark.createDataFrame([("A", "o\\x/a1.png", "in/zz.png", 1), ("A", "o/a1.png", "in/a.png", 2)], "label string, output string, source string, at int"), "label", "output", "source", "at")
    derived = spark.createDataFrame([("A", "a1.png", "h3", 9)], "class_label string, name string, file_sha256 string, perceptual_hash long")
    rows = {r.name: r for r in manifest.canonical(originals, derived, made).collect()}
    assert rows["a1.png"].source_group == rows["a.png"].source_group == "INSCRIPTION::INS" and rows["a1.png"].augmentation_parent_id == "C1" and rows["a1.png"].is_augmented
    assert rows["b.png"].source_group == "WORD::W1" and rows["a.png"].estampage_id == ""
    with pytest.raises(Exception, match="no provenance or original: lost.png"):
        manifest.canonical(originals, spark.createDataFrame([("A", "lost.png", "h", 1)], derived.schema), made).collect()


def test_splits_exclude_collisions(spark):
    rows = [("a", "g1", False, "h1", 0b1, ""), ("b", "g2", False, "h2", 0b111111 << 20, ""), ("a1", "g1", True, "h9", 0b111 << 20, "a"), ("a2", "g1", True, "h2", 1 << 40, "a"), ("a3", "g1", True, "h8", 1 << 50, "a"), ("b1", "g2", True, "h7", 1 << 60, "b"), ("a4", "g1", True, None, None, "a")]
    m = spark.createDataFrame(rows, "name string, source_group string, is_augmented boolean, file_sha256 string, perceptual_hash long, augmentation_parent_id string")
    got = {r.name: r.split for r in manifest.apply_splits(m, spark.createDataFrame([("g1", "train"), ("g2", "test")], "grp string, split string"), 3).collect()}
    assert got == {"a": "train", "b": "test", "a1": "excluded_perceptual_collision", "a2": "excluded_perceptual_collision", "a3": "train", "b1": "excluded_parent_not_train", "a4": "train"}


def joins(df):
    """The joins of a plan, by which a table that is small as a file may or may not be gathered on the driver."""
    return re.findall(r"BroadcastHashJoin|BroadcastNestedLoopJoin|SortMergeJoin|ShuffledHashJoin", df._jdf.queryExecution().executedPlan().toString())


def test_near_pairs_are_not_broadcast(spark):
    codes = spark.createDataFrame([(i,) for i in range(50)], "code long")
    assert joins(dedup.near_pairs(codes, 3)) == ["SortMergeJoin"]


def test_cross_split_pairs_do_not_broadcast_masked_codes(spark):
    m = spark.createDataFrame([(i, "train" if i % 2 else "test") for i in range(50)], "perceptual_hash long, split string")
    assert joins(manifest.cross_split_pairs(m, 3)).count("SortMergeJoin") == 1


def test_duplicate_components_do_not_broadcast_masked_codes(spark, monkeypatch):
    edges = []
    monkeypatch.setattr("quern.operators.graph.components", lambda e: edges.append(e) or e.select(F.col("a").alias("node"), F.col("b").alias("root")))
    QUERIES["duplicate_components"](spark, SF)
    assert joins(edges[0]) == ["SortMergeJoin"]


def test_components_near_each_other_are_not_broadcast(spark):
    t = spark.createDataFrame([(i // 10, i, i * 7 % 90, i * 3 % 60) for i in range(40)], "image long, id long, x long, y long")
    assert joins(geometry.near_centres(t, t, ["image"], 20, 10)) == ["SortMergeJoin"]


def test_attached_dots_broadcast_no_components(spark):
    from quern.plans.shapes import comps

    assert joins(shapes.attached_dots(shapes.classified(comps(spark, SF)))).count("SortMergeJoin") >= 2  # dots with mains, and neighbours of both


def test_post_filter_broadcasts_no_mains(spark):
    assert joins(QUERIES["post_filter_modes"](spark, SF)).count("SortMergeJoin") >= 6  # in each mode comps with mains, and neighbours for the mains


def places(spark, seed, n=160):
    """Unique keys on a grid with many in one place, some that stand apart, and nulls."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(6), rng.choice([90.0 + rng.randrange(80) / 10, 95.0, 99.1 + rng.random() / 1000])) for i in range(n)] + [(900, 60, 95.0), (901, 3, None), (902, None, 95.0), (903, 3, 400.0), (904, 4, 398.5)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key long, x int, y double").repartition(3)


def within(a, b, dx, dy):
    return None not in (a[1], a[2], b[1], b[2]) and abs(a[1] - b[1]) <= dx and abs(a[2] - b[2]) <= dy


def test_box_pairs_are_not_broadcast(spark):
    rows, df = places(spark, 1)
    pairs = geometry.near_box_pairs(df, "key", "x", "y", 1, 2.5)
    assert joins(pairs) == ["SortMergeJoin"]
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and within(a, b, 1, 2.5))


@pytest.mark.parametrize("halvings", [0, 5])
def test_nearest_after_equals_brute_force_without_all_pairs(spark, halvings, monkeypatch):
    rows, df = places(spark, 2)
    met, near = [], geometry.near_centres
    monkeypatch.setattr(geometry, "near_centres", lambda *a: met.append(near(*a)) or met[-1])
    got = {r.a: (r.cost, r.main) for r in geometry.nearest_after(df, "key", "x", "y", 2, 2.0, 1.4, halvings).collect()}
    cost = lambda a, b: abs(a[1] - b[1]) + 1.4 * abs(a[2] - b[2])
    want = {a[0]: min(found) for a in rows if (found := [(cost(a, b), b[0]) for b in rows if a[0] < b[0] and within(a, b, 2, 2.0)])}
    assert got == want and any(c == 0 for c, _ in got.values()) and any(c > 1 for c, _ in got.values())
    assert met and joins(met[0]) == ["SortMergeJoin"]


def test_near_triples_shuffle_no_pairs(spark):
    rows, df = places(spark, 3, 70)
    t = geometry.near_triples(df, "key", "x", "y", 0.5, 1.0)
    assert joins(t) == ["SortMergeJoin"]
    pair = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and within(a, b, 0.5, 1.0)}
    want = sorted((i, j, k) for i, j in pair for j2, k in pair if j == j2 and (i, k) in pair)
    assert sorted(map(tuple, t.collect())) == want and len(want) > 50


@pytest.mark.parametrize("fan", [3, 1024])
def test_merged_groups_equal_brute_force(spark, fan):
    import hashlib

    rng = random.Random(fan)
    base = [rng.getrandbits(63) for _ in range(25)]
    rows = [(f"G{rng.randrange(60):02}", rng.choice([None, f"h{rng.randrange(200)}"]), rng.choice([None, rng.choice(base) ^ (1 << rng.randrange(63)), rng.getrandbits(63)])) for _ in range(150)]
    rows += [(f"H{i:02}", "same", None) for i in range(20)] + [(None, "same", base[0]), rows[0], ("alone", None, None)]
    group = {g: g for g, _, _ in rows if g is not None}
    named = [r for r in rows if r[0] is not None]
    for i, (g, h, c) in enumerate(named):
        for o, k, d in named[:i]:
            near = (h is not None and h == k) or (c is not None and d is not None and (c ^ d).bit_count() <= 2)
            if near and group[g] != group[o]:
                old, new = group[g], group[o]
                group = {x: new if r == old else r for x, r in group.items()}

    digest = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()

    def name(members):
        level = [digest(members[i : i + fan]) for i in range(0, len(members), fan)]
        while len(level) > 1:
            level = [digest(level[i : i + fan]) if len(level[i : i + fan]) > 1 else level[i] for i in range(0, len(level), fan)]
        return "SOURCE_COMPONENT::" + level[0][:16]

    want = {g: name(sorted(x for x in group if group[x] == r)) for g, r in group.items()}
    got = manifest.merged_groups(spark.createDataFrame(rows, "source_group string, file_sha256 string, perceptual_hash long"), 2, fan=fan).collect()
    assert {r.source_group: r.split_group_id for r in got} == want and len(got) == len(want) and 2 < len(set(want.values())) < len(want)
    assert manifest.merged_groups(spark.createDataFrame([], "source_group string, file_sha256 string, perceptual_hash long"), 2).count() == 0


def test_merged_group_of_any_size_is_named_by_all_its_members(spark):
    import hashlib

    big, small = [f"G{i:04}" for i in range(1503)], ["x", "y"]
    rows = [(g, "big", None) for g in big] + [(g, "small", None) for g in small] + [("alone", None, None)]
    got = manifest.merged_groups(spark.createDataFrame(rows, "source_group string, file_sha256 string, perceptual_hash long").repartition(5), 2).collect()
    name = lambda members: "SOURCE_COMPONENT::" + hashlib.sha256("\n".join(members).encode()).hexdigest()[:16]
    assert {r.source_group: r.split_group_id for r in got} == {g: name(m) for m in (big, small, ["alone"]) for g in m}


def test_merged_splits_of_a_large_component_equal_sql(spark, tmp_path):
    import hashlib

    import duckdb

    import __spark_entry__ as entry

    words = lambda n: hashlib.md5(str(n).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
    texts = [words((i, 1)) if i % 3 == 1 else words(i // 3) for i in range(8700)]  # over 1,024 crops each share a file with a row of one inscription
    docs = [(i, " ".join(t[k : k + 2] for k in range(0, 32, 2)), "en", "s" if i // 3 % 20 else "t", i % 977) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = db.sql(entry.oracle_sql()["merged_group_splits"]).fetchall()
    got = entry.queries()["merged_group_splits"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_merged_splits_hold_groups_together(spark):
    rows = [("a", "g1", False, "h1", 1, ""), ("b", "g2", False, "h1", None, ""), ("c", "g3", False, "h3", 7 << 30, ""), ("d", "g4", False, "h4", 5 << 30, ""), ("d1", "g4", True, "h5", None, "d")]
    m = spark.createDataFrame(rows, "name string, source_group string, is_augmented boolean, file_sha256 string, perceptual_hash long, augmentation_parent_id string")
    merged = manifest.merged_groups(m.filter("not is_augmented"), 2)
    ids = {r.source_group: r.split_group_id for r in merged.collect()}
    assert ids["g1"] == ids["g2"] != ids["g3"] == ids["g4"]
    assigned = spark.createDataFrame([(ids["g1"], "train"), (ids["g3"], "test")], "grp string, split string")
    got = {r.name: (r.split, r.split_group_id) for r in manifest.apply_splits(m, assigned, 2, merged).collect()}
    assert got == {"a": ("train", ids["g1"]), "b": ("train", ids["g1"]), "c": ("test", ids["g3"]), "d": ("test", ids["g3"]), "d1": ("excluded_parent_not_train", ids["g3"])}


def test_strict_values_raise(spark):
    one = lambda v, g: spark.createDataFrame([(v,)], "x string").select(g(F.col("x")).alias("r")).first().r
    assert (one(" TRUE", governance.truth), one("3.0", governance.whole), one("1e-3", governance.finite)) == (True, 3, 0.001)
    for bad, g in (("yes", governance.truth), ("2.5", governance.whole), ("inf", governance.finite), ("", governance.finite), (None, governance.whole)):
        with pytest.raises(Exception, match="no (number|whole number|truth value)"):
            one(bad, g)
    assert one("a" * 64, governance.is_digest) and not one("A" * 64, governance.is_digest) and not one(None, governance.is_digest)
    assert one("1", lambda c: governance.close(c.cast("double"), F.lit(1 + 1e-10))) and not one("1", lambda c: governance.close(c.cast("double"), F.lit(1.001)))


def test_key_guard_walks_the_tree(spark):
    docs = [('{"a": [{"b": {"Test_x": 1}}]}',), ('{"a": "test: \\"test\\": 1", "test_access": {"c": ["test"]}}',), ('{"latest": null}',), (None,), ("{}",)]
    got = [r.doc[:10] for r in governance.guarded(spark.createDataFrame(docs, "doc string"), "doc").collect()]
    assert got == [docs[0][0][:10], docs[2][0][:10]]
    spelt = [(1, '{"\\u0074est_\\"q\\"" : 1}'), (2, '{"\\u0074est_access": "test"}'), (3, '{"a\\u003atest": 0, "bad\\x": {"tes\\t": 2}}')]
    found = governance.guarded(spark.createDataFrame(spelt, "id int, doc string"), "doc").collect()
    assert {r.id: r["keys"] for r in found} == {1: ['test_"q"'], 3: ["a:test"]}


def test_frozen_tables_and_verification(spark):
    t = spark.createDataFrame([("train", "x"), ("train", "y"), ("train", "y"), ("test", "z")], "part string, line string")
    a = governance.frozen(t, "part", F.col("line"))
    again = governance.frozen(t.orderBy(F.desc("line")).repartition(3), "part", F.col("line"))
    once = governance.frozen(t.distinct().union(t.filter("line = 'x'")), "part", F.col("line"))
    status = lambda b, *d: {r.part: r.status for r in governance.verify_frozen(a, b, "part", d).collect()}
    assert status(again) == {"train": "match", "test": "match"} and status(once, "test") == {"train": "mismatch", "test": "deferred"}
    assert status(again.filter("part = 'test'").union(again.filter("part = 'test'").withColumn("part", F.lit("new")))) == {"train": "missing", "test": "match", "new": "extra"}


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "id int, x double")
    manifests.write_json(df, f"file://{tmp_path}/j")
    assert sorted(map(tuple, spark.read.json(f"file://{tmp_path}/j").select("id", "x").collect())) == [(1, 0.5), (2, None)]
    with pytest.raises(Exception, match="(?i)exist"):
        manifests.write_json(df, f"file://{tmp_path}/j")
    with pytest.raises(Exception, match="no JSON number"):
        manifests.write_json(df.union(spark.createDataFrame([(3, float("nan"))], df.schema)), f"file://{tmp_path}/k")


def test_files_and_json_scans(spark, tmp_path):
    import hashlib

    for name in ("क/a.PNG", "क/b.txt", "ख/c.jpg"):
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(name.encode())
    got = {(r.label, r.name) for r in manifests.list_files(spark, f"file://{tmp_path}/f").collect()}
    assert len(got) == 2 and {n for _, n in got} == {"a.PNG", "c.jpg"}
    assert {r.sha256 for r in manifests.file_hashes(spark, f"file://{tmp_path}/f").collect()} == {hashlib.sha256(n.encode()).hexdigest() for n in ("क/a.PNG", "क/b.txt", "ख/c.jpg")}
    (tmp_path / "one.json").write_text('{"a": {"b": [1, 2]}}')
    assert manifests.read_json(spark, f"file://{tmp_path}/one.json").first().a.b == [1, 2]
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("l", 1, "only")], "key string, at int, v string")
    assert {(r.key, r.v) for r in manifests.keep_last(rows, ["key"], "at").collect()} == {("k", "new"), ("l", "only")}
    manifests.write_split(rows.withColumn("split", F.col("key")), f"file://{tmp_path}/s")
    assert sorted(r.split for r in spark.read.parquet(f"file://{tmp_path}/s").collect()) == ["k", "k", "l"]


def test_vectors_and_boxes(spark):
    row = spark.range(1).select(V.cosine(V.doubles(F.array(F.lit(1), F.lit(0))), V.doubles(F.array(F.lit(1), F.lit(1)))).alias("c"), V.sigmoid(F.lit(0.0)).alias("s"), V.log_softmax(F.array(F.lit(1000.0), F.lit(0.0))).alias("l")).first()
    assert row.c == pytest.approx(0.5**0.5) and row.s == 0.5 and row.l == [0.0, -1000.0]
    box = lambda x0, y0, x1, y1: {k: F.lit(v) for k, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)}
    touch = spark.range(1).select(geometry.overlaps_expanded(box(0, 0, 5, 5), box(8, 0, 9, 5), 3).alias("a"), geometry.overlaps_expanded(box(0, 0, 5, 5), box(9, 0, 9, 5), 3).alias("b")).first()
    assert touch.a and not touch.b


def test_component_rules(spark):
    rows = [("edge", 2, 300, 250, 320, 500), ("inner", 3, 300, 250, 320, 5000), ("strip", 100, 100, 200, 107, 400), ("thick", 100, 100, 200, 108, 600), ("speck", 500, 500, 502, 502, 9)]
    t = spark.createDataFrame(rows, "id string, x0 int, y0 int, x1 int, y1 int, area int").selectExpr("*", "1 AS image", "0.5D AS depth", "0.2D AS alpha", "1000 AS page_w", "700 AS page_h")
    got = {r.id: (r.b, r.kind) for r in shapes.classified(t).withColumn("b", shapes.border_or_strip()).collect()}
    assert got == {"edge": (True, "rejected"), "inner": (False, "rejected"), "strip": (True, "rejected"), "thick": (False, "main"), "speck": (False, "dot")}


def test_floor_mode_follows_noise_and_limits(spark):
    rng = random.Random(3)
    level = {0: 0.0, 1: 0.4, 2: 1.0}
    rows = [(i, i % 3, x := rng.randrange(900), y := rng.randrange(600), x + rng.randrange(60), y + rng.randrange(50), rng.randrange(1, 60), rng.random() * 0.15, rng.random() * 0.3) for i in range(400)]
    t = spark.createDataFrame(rows, "id int, image int, x0 int, y0 int, x1 int, y1 int, area int, depth double, alpha double").selectExpr("*", "1000 AS page_w", "700 AS page_h")
    noisy = spark.createDataFrame(list(level.items()), "image int, noise double")
    mains = t.filter("id < 12")

    def want(mark):
        out = {}
        for i, image, x0, y0, x1, y1, area, depth, _ in rows:
            w, h, n = x1 - x0 + 1, y1 - y0 + 1, level[image]
            centre = lambda r: ((r[2] + r[4]) / 2, (r[3] + r[5]) / 2)
            (x, y), side = centre(rows[i]), max(w, h)
            near = any(r[1] == image and abs(x - centre(r)[0]) <= max(58, (r[4] - r[2] + 1) * 0.85) and abs(y - centre(r)[1]) <= max(42, (r[5] - r[3] + 1) * 0.95) for r in rows[:12])
            first = side >= 7 and area >= mark - 3 and depth >= 0.0377 and area / (w * h) >= 0.018
            second = (near or n < 0.28 or side >= 13) and area >= mark + round(6 * n) and depth >= 0.065 * (0.58 + n * 0.26) and area / (w * h) >= 0.025 + n * 0.035
            third = near and area >= mark + round(6 * n) and depth >= 0.085 * (0.62 + n * 0.16) and side <= 42
            out[i] = first or second or third
        return out

    for limits in (shapes.Limits(), shapes.Limits(mark_area=25)):
        got = {r.id: r.kept for r in shapes.post_kept(t, mains, "floor", noisy, limits).collect()}
        assert got == want(limits.mark_area) and 20 < sum(got.values()) < 380


def test_samplers(spark):
    rows = spark.range(200).selectExpr("id", "id % 4 AS g", "1.0D AS w", "(id + 1) / 201.0D AS u")
    got = [r.id for r in split.weighted_without_replacement(rows, ["g"], "w", "u", 3).collect()]
    assert sorted(got) == list(range(188, 200))
    few = spark.createDataFrame([("a", i, 1) for i in range(2)] + [("b", 10 + i, i) for i in range(9)], "label string, id int, parent int")
    e = split.episodes(few, "label", "id", "parent", 2, 2, 2, 2).collect()
    assert len({(r.episode, r.label) for r in e}) == 4
    b = [r for r in e if r.label == "b"]
    assert len(b) == 8 and len({(r.episode, r.id) for r in b}) == 8 and sum(r.role == "support" for r in b) == 4
    a = [r for r in e if r.label == "a"]
    assert len(a) == 6  # one row of its only parent, and both rows drawn again


def test_windowed_counts_batch_and_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00"), ("a", "2024-01-01 06:00:00")]
    df = spark.createDataFrame(rows, "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {("a", 2), ("b", 1), ("a", 1)}
    assert {(r.k, r.n) for r in crossing.windowed_counts(df, "ts", "k").collect()} == want
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = crossing.windowed_counts(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), "ts", "k")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.n) for r in spark.table("counts").collect()} == want


def test_exemplar_minimum_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6))
    rows = spark.createDataFrame([(i, "abc"[i % 3], v) for i, v in enumerate(x.tolist())] + [(500, "a", None)], "id long, label string, v array<double>")
    got = {(r.id, r.cls): r.dist2 for r in similarity.exemplar_min(rows.filter("id % 10 = 0"), rows, "id", "label", "v", block=16).collect()}
    want = {(i, c): min(((x[i] - x[j]) ** 2).sum() for j in range(120) if "abc"[j % 3] == c) for i in range(0, 120, 10) for c in "abc"}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_local_folder_is_refused_on_a_cluster(spark):
    from types import SimpleNamespace

    from quern.operators import graph

    conf = SimpleNamespace(get=lambda key, default=None: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graph.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))

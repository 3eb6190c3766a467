from __future__ import annotations

import pytest

from sievework.llm import queries

from ..oracle import assert_same, connect


@pytest.mark.parametrize("name", [*queries.SQL])
def test_query_equals_sql(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data), connect(data), queries.SQL[name])


@pytest.mark.parametrize("name", [*set(queries.QUERIES) - set(queries.SQL)])
def test_query_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize(
    "name, columns",
    [
        ("p2_found", [("table_name", "string"), ("row_id", "bigint"), ("canonical_class", "string")]),
        ("p3_found", [("image", "string"), ("group_image", "string")]),
        ("p5_found", [("review_id_a", "bigint"), ("review_id_b", "bigint")]),
        ("p8_found", [("doc_id", "bigint")]),
    ],
)
def test_found_columns(spark, data, name, columns):
    assert queries.QUERIES[name](spark, data).dtypes == columns


@pytest.fixture(scope="module")
def larger(data):
    return data.replace("sf0.001", "sf0.01")


def test_labels_invariants(spark, larger):
    """A row for each open label, and names as they are listed keep their entry."""
    db = connect(larger)
    sides = """select 'class_mapping' t, mapping_id i, original_class l, canonical_class c from class_mapping union all select 'class_taxonomy_review', taxonomy_id, raw_class, canonical_class from class_taxonomy_review"""
    open_rows = db.sql(f"select t, i, l from ({sides}) where coalesce(trim(c), '') in ('', 'REVIEW_REQUIRED') and trim(coalesce(l, '')) <> ''").fetchall()
    got = {(r[0], r[1]): r[2] for r in queries.p2_found(spark, larger).collect()}
    assert set(got) == {(t, i) for t, i, _ in open_rows} and len(open_rows) == len(got)
    plain = {e.replace("_", " "): e for (e,) in db.sql("select canonical_class from canonical_classes").fetchall()}
    exact = [(t, i, plain[x]) for t, i, l in open_rows if (x := l.lower().replace("_", " ").strip()) in plain]
    assert len(exact) > 10 and all(got[t, i] == e for t, i, e in exact)


def test_splits_invariants(spark, larger):
    """No group is in two splits, no file twice, and the splits have their shares."""
    db = connect(larger)
    split = {r["review_id"]: r["split"] for r in queries.p4_splits(spark, larger).collect()}
    assert len(split) == db.sql("select count(distinct review_id) from duplicate_review").fetchall()[0][0]
    of_group = {}
    for i, g in db.sql("select review_id, group_id from duplicate_review where group_id is not null and review_id is not null").fetchall():
        assert of_group.setdefault(g, split[i]) == split[i]
    for s, share in db.sql("select split, target_share from split_targets").fetchall():
        assert abs(sum(x == s for x in split.values()) / len(split) - share) < 0.02


def test_containers_invariants(spark, larger):
    """Every token of every text lies in one container of each kind, and none is too full."""
    from sievework.llm.tokens import token_lengths

    tokens = {r["doc_id"]: r["tokens"] for r in token_lengths(queries.table(spark, larger, "documents"), "text", ["doc_id"]).collect() if r["tokens"]}
    capacity = {r["container"]: r["capacity_tokens"] for r in queries.table(spark, larger, "pack_limits").collect()}
    full, held = {}, {}
    for r in queries.p6_containers(spark, larger).collect():
        full[r["container"], r["container_id"]] = full.get((r["container"], r["container_id"]), 0) + r["length"]
        held.setdefault((r["container"], r["doc_id"]), []).append((r["piece"], r["length"]))
    assert all(n <= capacity[c] for (c, _), n in full.items())
    assert set(held) == {(c, d) for c in capacity for d in tokens}
    for (c, d), pieces in held.items():
        assert sum(n for _, n in pieces) == tokens[d] and sorted(p for p, _ in pieces) == [*range(len(pieces))]
        assert len(pieces) == 1 or all(n == capacity[c] for _, n in sorted(pieces)[:-1])


def test_mix_invariants(spark, larger):
    """No text is used more often than its source allows, and the report counts the uses."""
    uses, report = queries.mixed(spark, larger)
    most = {r["source"]: r["max_repeats"] for r in queries.table(spark, larger, "mix_targets").collect()}
    used, times = {}, {}
    for r in uses.collect():
        used[r["source"]] = used.get(r["source"], 0) + r["tokens"]
        times[r["doc_id"], r["source"]] = times.get((r["doc_id"], r["source"]), 0) + 1
    assert all(n <= most[s] for (_, s), n in times.items())
    told = {r["source"]: r for r in report.collect()}
    assert {s: r["used_tokens"] for s, r in told.items() if r["used_tokens"]} == used
    assert all(abs(r["share"] - used.get(s, 0) / sum(used.values())) < 1e-9 for s, r in told.items())


def test_restored_texts_round_trip(spark, larger):
    """Clean texts of the table, garbled here as a whole, come back as they were."""
    from sievework.llm.garbled import _decode, examine_texts

    docs = queries.table(spark, larger, "documents").where("text is not null").select("doc_id", "text")
    bad = {r["doc_id"] for r in queries.p8_found(spark, larger).collect()}
    clean = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in bad and not r["text"].isascii() and "&" not in r["text"]}
    some = {-i - 1: (t, _decode(t.encode(), read)) for i, t in [*clean.items()][:120] for read in ("latin-1",)}
    mixed = docs.unionByName(spark.createDataFrame([(i, g) for i, (_, g) in some.items()], "doc_id bigint, text string"))
    got = {r["doc_id"]: r["restored"] for r in examine_texts(mixed, "doc_id", "text").where("doc_id < 0").collect()}
    assert set(got) == set(some)
    assert sum(got[i] == t for i, (t, _) in some.items()) >= 0.97 * len(some)

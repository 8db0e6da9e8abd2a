"""Exact dedup, line dedup, mixing, sharding, URL templates."""

import hashlib
import os
import zlib
from collections import Counter

import pytest
from llm.conftest import ODD_TEXTS
from pyspark.sql import functions as F

from checks.compare import difference, table_views
from tacitrec.llm.exact_dedup import StreamingDedup
from tacitrec.llm.line_dedup import LineRuns, drop_frequent_lines
from tacitrec.llm.mixing import emit, mix, source_targets
from tacitrec.llm.oracle import ORACLE_SQL
from tacitrec.llm.queries import QUERIES
from tacitrec.llm.sharding import assign, balanced_tree, slots, with_one_more
from tacitrec.llm.url_templates import TemplateParams, filter_urls, rule_for, template_verdicts
from tacitrec.tables import new_path

BLANKS = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, small_tables, name):
    import duckdb

    connection = duckdb.connect()
    table_views(connection, small_tables)
    assert difference(QUERIES[name](spark, small_tables), connection, ORACLE_SQL[name]) is None


# --- exact dedup --------------------------------------------------------------------

def plain_verdicts(rows):
    normal = {i: "".join(c for c in text or "" if c not in BLANKS) for i, (_, text) in enumerate(rows)}
    result = []
    for i, (doc, text) in enumerate(rows):
        group = [k for k in normal if normal[k] == normal[i]]
        best = min(group, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0))
        result.append((doc, rows[best][0], len(group), hashlib.sha256(normal[i].encode()).hexdigest()))
    return Counter(result)


def written(docs, folder, mode="overwrite"):
    docs.write.mode(mode).parquet(folder)
    return folder


@pytest.mark.parametrize("digest", [None, lambda text: F.substring(F.sha2(text, 256), 1, 1)])
def test_groups_are_those_of_the_whole_texts(spark, docs_of, tmp_path, digest):
    """Also with a digest so short that different texts share it."""
    texts = [*ODD_TEXTS, "a b", "a  b", "ab", "a\nb ", *["many"] * 30]
    docs = docs_of(texts, ids=[None, None, *range(len(texts) - 2)])
    path = written(docs.withColumn("digest", F.lit(1)).withColumn("file", F.lit("x")), str(tmp_path / "d.parquet"))
    more = {"digest": digest} if digest else {}
    dedup = StreamingDedup(spark, path, new_path(spark, "state"), **more)
    dedup.advance()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = dedup.verdicts().collect()
    expected = plain_verdicts(rows)
    assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in found) == Counter(
        {k[:3]: 0 for k in expected}
    ) + Counter(e[:3] for e in expected.elements())
    assert sum(r["kept"] for r in found) == len({e[3] for e in expected})


def test_state_goes_on_with_new_files(spark, docs_of, tmp_path):
    path, state = str(tmp_path / "d.parquet"), new_path(spark, "state")
    written(docs_of(["one", "two", "o n e"]), path)
    dedup = StreamingDedup(spark, path, state)
    dedup.advance()
    first = {r["id"]: r["keep_id"] for r in dedup.verdicts().collect()}
    assert first == {0: 2, 1: 1, 2: 2}
    written(docs_of(["t w o", "three"], ids=[10, 11]), path, "append")
    again = StreamingDedup(spark, path, state)
    again.advance()
    assert {r["id"]: (r["keep_id"], r["group_size"]) for r in again.verdicts().collect()} == {
        0: (2, 2), 1: (10, 2), 2: (2, 2), 10: (10, 2), 11: (11, 1),
    }
    assert "rocksdb" not in str(spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")).lower()


def test_hot_digests_are_spread(spark, docs_of, tmp_path, monkeypatch):
    import tacitrec.llm.exact_dedup as module

    monkeypatch.setattr(module, "HOT_ROWS", 5)
    path = written(docs_of(["same"] * 40 + [f"own {i}" for i in range(20)]).repartition(3), str(tmp_path / "d.parquet"))
    dedup = StreamingDedup(spark, path, new_path(spark, "state"))
    dedup.advance()
    found = dedup.verdicts()
    assert "_salt" in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert Counter((r["keep_id"], r["group_size"]) for r in rows if r["id"] < 40) == {(0, 40): 40}
    assert sum(r["kept"] for r in rows) == 21 and len(rows) == 60


def test_late_files_with_old_times_are_taken_in(spark, docs_of, tmp_path):
    path, state = str(tmp_path / "d.parquet"), new_path(spark, "state")
    written(docs_of(["one", "two"]), path)
    StreamingDedup(spark, path, state).advance()
    before = set(os.listdir(path))
    written(docs_of(["t w o", "three"], ids=[10, 11]), path, "append")
    for name in set(os.listdir(path)) - before:
        os.utime(f"{path}/{name}", (1e9, 1e9))
    again = StreamingDedup(spark, path, state)
    with pytest.raises(ValueError, match="4 rows"):
        again.verdicts()
    again.advance()
    assert {r["id"]: (r["keep_id"], r["group_size"]) for r in again.verdicts().collect()} == {
        0: (0, 1), 1: (10, 2), 10: (10, 2), 11: (11, 1),
    }


def test_dedup_of_an_empty_table(spark, docs_of, tmp_path):
    path = written(docs_of(["x"]).limit(0), str(tmp_path / "d.parquet"))
    dedup = StreamingDedup(spark, path, new_path(spark, "state"))
    dedup.advance()
    assert dedup.verdicts().count() == 0


# --- line dedup ---------------------------------------------------------------------

def plain_lines(texts, least):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    split = [(t or "").split("\n") for t in texts]
    counts = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    return [
        ("\n".join(x for x in lines if not key(x) or counts[key(x)] < least), len(lines)) for lines in split
    ]


@pytest.mark.parametrize("batches, fanout", [(1, 4), (5, 2)])
def test_frequent_lines_go(docs_of, batches, fanout):
    shared = ["Shared Line", " shared line\t", "SHARED LINE\r"]
    texts = [*ODD_TEXTS, *[f"own {i}\n{shared[i % 3]}\nmiddle {i // 2}\n\n{shared[0]}" for i in range(9)], *["copy\nof"] * 4, "É\né"]
    docs = docs_of(texts).withColumn("n_lines", F.lit("x")).withColumn("line", F.lit("y"))
    rows = drop_frequent_lines(docs, min_docs=4, batches=batches, fanout=fanout).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for row, text, (kept, n) in zip(rows, texts, plain_lines(texts, 4)):
        assert (row["text"] or "") == kept and row["n_lines"] == n
        assert row["n_dropped"] == (n - len(kept.split("\n")) if kept or not row["n_dropped"] else n)
        assert (row["text"] is None) == (text is None)


def test_runs_are_compacted_and_closed(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(b"a", 1), (bytes([batch]), 1), (b"a", 1)], "line binary, n_docs bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [bytes(r["line"]) for r in runs.frequent().collect()] == [b"a"]
    names = list(runs.paths)
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_line_dedup_of_an_empty_table(docs_of):
    assert drop_frequent_lines(docs_of(["x"]).limit(0)).count() == 0


# --- mixing -------------------------------------------------------------------------

def test_targets_fill_up_like_water(spark, docs_of):
    docs = docs_of([str(n) for n in (100, 10, 40, 0, 7, 300)], sources=["b", "a", "c", "d", None, "a"])
    rows = source_targets(docs, "source", F.col("text").cast("bigint")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes, weights = [310, 100, 40, 0, 7], [5, 2, 1, 5, 2]
    assert [r["source_size"] for r in rows] == sizes
    level = 0.0
    for _ in range(10):
        capped = [level * w >= 3 * s for w, s in zip(weights, sizes)]
        level = (457 - sum(3 * s for s, c in zip(sizes, capped) if c)) / sum(w for w, c in zip(weights, capped) if not c)
    assert [r["target"] for r in rows] == pytest.approx([min(level * w, 3 * s) for w, s in zip(weights, sizes)])
    assert sum(r["target"] for r in rows) == pytest.approx(457)


def test_copies_follow_the_rate(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"),
        (F.col("id") % 17).alias("words"), F.lit("x").alias("copies"), F.lit("y").alias("target"),
    )
    mixed = mix(docs, "doc_id", "source", F.col("words"))
    rows = mixed.collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert r["copies"] <= 3
    assert all(abs(taken[s] / target[s] - 1) < 0.1 for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs.repartition(3), "doc_id", "source", F.col("words")).collect()))
    assert emit(mixed.select("doc_id", "copies")).count() == sum(r["copies"] for r in rows)


def test_mixing_odd_tables(docs_of):
    docs = docs_of(["a b", None, "c"], ids=[None, 5, 5], sources=[None, None, None])
    assert sorted(r["target"] for r in mix(docs, "doc_id", "source", F.length("text")).collect()) == [4.0] * 3
    assert all(r["copies"] == 0 and r["target"] == 0 for r in mix(docs, "doc_id", "source", F.lit(0)).collect())
    assert mix(docs.limit(0), "doc_id", "source", F.lit(1)).count() == 0


# --- sharding -----------------------------------------------------------------------

def test_only_the_new_shard_takes_rows(spark):
    tree = balanced_tree(3, 2, 2)
    rows = assign(assign(spark.range(12000), "id", tree), "id", with_one_more(tree), "grown").collect()
    assert all(r["grown"] in (r["shard"], 12) for r in rows)
    counts, grown = Counter(r["shard"] for r in rows), Counter(r["grown"] for r in rows)
    assert sorted(counts) == list(range(12)) and max(counts.values()) < 1.15 * 1000 and min(counts.values()) > 0.85 * 1000
    assert abs(grown[12] - 12000 / 13) < 150


def test_weights_and_confined_moves(spark):
    tree = (((1.0, 3.0), (2.0,)), ((2.0, 2.0),))
    heavier = (((1.0, 3.0), (2.0,)), ((2.0, 6.0),))
    rows = assign(assign(spark.range(10000), "id", tree), "id", heavier, "grown").collect()
    counts = Counter(r["shard"] for r in rows)
    assert [round(counts[s] / 1000) for s in range(5)] == [1, 3, 2, 2, 2]
    for r in rows:  # moves go to the heavier region and, within it, to the heavier shard
        if r["grown"] != r["shard"]:
            assert r["grown"] >= 3 and (r["shard"] < 3 or r["grown"] == 4)


def test_slots_are_gapless_and_odd_rows_have_shards(spark, docs_of):
    docs = docs_of(["a"] * 60, ids=[None] * 25 + [3] * 20 + list(range(15))).withColumn("shard", F.lit("x"))
    rows = slots(assign(docs, "doc_id", balanced_tree(2, 1, 2)), "shard", ["doc_id"]).collect()
    assert len(rows) == 60 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0))
    for placed in by_shard.values():
        placed.sort()
        assert [p[0] for p in placed] == list(range(len(placed)))
        assert [p[1:] for p in placed] == sorted(p[1:] for p in placed)
    empty = assign(docs.limit(0), "doc_id", balanced_tree(2, 1, 2))
    assert slots(empty, "shard", ["doc_id"]).count() == 0


def test_law_is_the_key(spark, tables_of):
    folder = tables_of(["a", None, "b c"], ids=[7, 8, 9])
    small = {r["doc_id"]: r for r in QUERIES["op10_sharding"](spark, folder).collect()}
    assert small[8]["size"] == 16 and small[8]["text_crc32"] == 0 and small[9]["text_crc32"] == zlib.crc32(b"b c")


# --- URL templates ------------------------------------------------------------------

def urls_of(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")


def test_tree_generalises_merges_and_rejects(spark):
    urls = [f"https://A.com/news/{i}" for i in range(60)] + [f"https://a.com/blog/{i}" for i in range(60)]
    urls += [f"http://a.com/spam/{i}?q=1" for i in range(60)] + [f"https://b.org/x/{i}/y" for i in range(30)]
    labels = spark.createDataFrame(
        [(u, i % 10 != 0 if "spam" not in u else i % 10 == 0) for i, u in enumerate(urls) if i % 2 == 0], "url string, good boolean"
    )
    rows = template_verdicts(urls_of(spark, urls), labels, params=TemplateParams(min_support=5)).collect()
    seen = {(r["host"], r["template"]): r["verdict"] for r in rows}
    assert seen == {("a.com", "/+2/*"): "allow", ("a.com", "/spam/*"): "block", ("b.org", "/x/*/y"): "allow"}
    assert len(rows) == len(urls)


def verdicts_of(spark, urls, good, **params):
    """Verdicts of urls that are all labelled."""
    labels = spark.createDataFrame([(u, good(u)) for u in urls], "url string, good boolean")
    rows = template_verdicts(urls_of(spark, urls), labels, params=TemplateParams(**params)).collect()
    return {urls[r["page_id"]]: r["verdict"] for r in rows}, {urls[r["page_id"]]: r["template"] for r in rows}


def test_a_small_section_of_its_own_labels_is_found(spark):
    """Sixty sections of sixty urls, each under 2% of the host, one of them bad."""
    urls = [f"http://h/s{section}/{i}" for section in range(60) for i in range(60)]
    verdict, template = verdicts_of(spark, urls, lambda u: "/s7/" not in u)
    assert {u for u in urls if verdict[u] == "block"} == {u for u in urls if "/s7/" in u}
    assert template["http://h/s7/1"] == "/s7/*" and template["http://h/s8/1"] == "/*/*"


def test_a_deep_section_of_its_own_labels_is_found(spark):
    deep = "http://h/" + "/".join("abcdefghijkl")
    urls = [f"{deep}/{section}/{i}" for section in ("bad", "good", "fine") for i in range(100)]
    verdict, _ = verdicts_of(spark, urls, lambda u: "/bad/" not in u)
    assert {u for u in urls if verdict[u] == "block"} == {u for u in urls if "/bad/" in u}


def test_graded_sections_do_not_chain(spark):
    """Eleven sections with bad shares 0, 0.1 ... 1: the ends are never judged together."""
    urls = [f"http://h/s{section}/{i}" for section in range(11) for i in range(30)]
    verdict, template = verdicts_of(spark, urls, lambda u: int(u.split("/")[-1]) % 10 >= int(u.split("/")[-2][1:]))
    assert verdict["http://h/s10/1"] == verdict["http://h/s9/1"] == "block" and verdict["http://h/s0/1"] == verdict["http://h/s1/1"] == "allow"
    assert template["http://h/s10/1"] != template["http://h/s5/1"] != template["http://h/s0/1"]


def test_hot_templates_are_spread(spark, monkeypatch):
    import tacitrec.llm.url_templates as module

    monkeypatch.setattr(module, "LEAST_HEAVY", 10)
    urls = [f"http://h/news/{i}" for i in range(120)] + ["http://h/same"] * 40 + [f"http://o/{i}/x" for i in range(9)]
    verdict, template = verdicts_of(spark, urls, lambda u: "news" in u, min_support=5)
    assert template["http://h/news/5"] == "/news/*" and template["http://h/same"] == "/same" and len(verdict) == 130
    none = spark.createDataFrame([], "url string, good boolean")
    assert template_verdicts(urls_of(spark, urls), none).count() == len(urls)


def test_an_id_named_like_a_result_is_called_id(spark):
    urls = urls_of(spark, ["http://h/a"]).withColumnRenamed("page_id", "host")
    none = spark.createDataFrame([], "url string, good boolean")
    assert filter_urls(urls, none, (), id="host").columns[:3] == ["id", "host", "path"]


def test_rules(spark):
    rules = (("org/", "allow"), ("example.org/es/", "block"), ("com/fr/", "allow"))
    cases = {
        ("a.example.org", "/es/1"): "example.org/es/", ("example.org", "/fr/"): "org/", ("org", "/"): "org/", ("org", ""): None,
        ("xorg", "/"): None, ("x.com", "/fr/9"): "com/fr/", ("com", "/f"): None, ("", ""): None,
    }
    table = spark.createDataFrame([(h, p) for h, p in cases], "host string, path string")
    found = table.select("host", "path", rule_for(F.col("host"), F.col("path"), rules)["rule"].alias("rule")).collect()
    assert {(r["host"], r["path"]): r["rule"] for r in found} == cases


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Ü.ORG?x", "a://b://c/d", "x://h/" + "/".join("abcdefghijkl"), "x://h", "x://h/", "x://h//", "x://H/\n/q#r"]
    none = spark.createDataFrame([], "url string, good boolean")
    rows = {r["page_id"]: r for r in filter_urls(urls_of(spark, urls).withColumn("host", F.lit(1)), none, ()).collect()}
    assert len(rows) == len(urls) and {r["verdict"] for r in rows.values()} == {"allow"}
    assert [(rows[i]["host"], rows[i]["path"]) for i in (0, 2, 4, 5, 10)] == [("", ""), ("", ""), ("Ü.org", ""), ("b:", "//c/d"), ("h", "/\n/q")]
    assert rows[6]["template"].endswith("/**")
    assert filter_urls(urls_of(spark, urls).limit(0), none, ()).count() == 0
    assert os.sep == "/"

"""The stages of the corpus pipeline, each against plain code on its own input."""

import math
import zlib
from collections import Counter

import numpy as np
from llm.conftest import ODD_TEXTS
from llm.test_language import PlainLanguages
from llm.test_simhash import plain_components, plain_fingerprint
from llm.test_structures import plain_lines
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tacitrec.llm.queries import pack_params

WORDS = "river stone light under over bridge seven winter garden paper window yellow morning quiet".split()
WOERTER = "fluss stein licht unter hinter brücke sieben winter garten papier fenster gelb morgen still".split()


def corpus(docs_of):
    """Two languages, a line that twelve documents share, near and exact copies, odd texts."""
    draw = np.random.default_rng(3)
    texts, langs = [], []
    for i in range(40):
        words = (WORDS, WOERTER)[i % 2]
        body = " ".join(draw.choice(words, 60))
        texts.append(body + ("\nAll rights reserved." if i < 12 else ""))
        langs.append(("en", "de")[i % 2])
    texts += [texts[20], texts[20], texts[21] + "\n", *ODD_TEXTS]
    langs += [None] * (len(texts) - 40)
    sources = [None if i % 7 == 0 else f"s{i % 3 and i % 2}" for i in range(len(texts))]
    docs = docs_of(texts, langs, sources, ids=[*range(100, 100 + len(texts) - 2), None, None])
    return docs.withColumn("size", F.lit("x")).withColumn("score", F.lit(1)).withColumn("copies", F.lit("y"))


def plain_rates(rows):
    """Per source, how often its documents are taken: targets filled like water, at most three times the size."""
    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, level = set(), 0.0
    while len(capped) < len(order):
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: (3.0 if s in capped else level * weight[s] / sizes[s]) if sizes[s] else 0.0 for s in order}


def plain_row(row):
    return tuple(row)


def test_stages_follow_the_plain_rules(spark, docs_of, tmp_path):
    docs = corpus(docs_of)
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        after = docs.collect()
        kept[name] = (before, after)
        if name != "packing":
            assert docs.columns == columns

    before, after = kept["language"]
    learned = [(r["text"], r["lang"]) for r in before if r["lang"] and not (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)]
    plain = PlainLanguages(learned)
    assert Counter(map(plain_row, after)) == Counter(plain_row(r) for r in before if plain.explains(r["text"]))
    assert {plain_row(r) for r in before if r["lang"]} <= {plain_row(r) for r in after}

    before, after = kept["lines"]
    expected = [kept_text for kept_text, _ in plain_lines([r["text"] for r in before], 10)]
    assert Counter((r["doc_id"], t) for r, t in zip(before, expected)) == Counter((r["doc_id"], r["text"] or "") for r in after)
    assert not any("rights reserved" in r["text"] for r in after)
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = kept["near duplicates"]
    label = plain_components(sorted({plain_fingerprint(r["text"]) for r in before}))
    groups = {}
    for r in before:
        groups.setdefault(label[plain_fingerprint(r["text"])], []).append(r)
    assert len(after) == len(groups) < len(before)
    last = float("inf")
    smallest = Counter(min(last if r["doc_id"] is None else r["doc_id"] for r in g) for g in groups.values())
    assert smallest == Counter(last if r["doc_id"] is None else r["doc_id"] for r in after)
    assert {plain_row(r) for r in after} <= {plain_row(r) for r in before}

    before, after = kept["mixing"]
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in before]
    copies = Counter(map(plain_row, after))
    rates, alike = plain_rates(rows), Counter(map(plain_row, before))
    assert set(copies) <= set(alike)
    for r in before:
        whole, n = math.floor(rates[r["source"]] + 1e-9), alike[plain_row(r)]
        assert whole * n <= copies[plain_row(r)] <= (whole + 1) * n

    before, after = kept["packing"]
    ids = Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in before)
    firsts = Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in after if r["start"] == 0)
    assert ids == firsts
    places = np.concatenate([r["sequence_id"] * 2048 + r["offset"] + np.arange(r["length"]) for r in after])
    assert sorted(places) == list(range(len(places)))
    tokenizer = Tokenizer.from_file(pack_params().tokenizer)
    tokens = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in before if r["doc_id"] is not None}
    for r in after:
        if r["doc_id"] is not None:
            ids = np.array(tokens[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
            assert (len(tokens[r["doc_id"]]), zlib.crc32(ids.tobytes())) == (r["doc_tokens"], r["ids_crc32"])


def test_mixtures_stay_and_unknown_languages_go(spark, docs_of):
    """Even mixtures of learned languages are text; other scripts, and letters without sense, are not."""
    draw = np.random.default_rng(4)
    palabras = "rio piedra luz debajo sobre puente siete invierno jardin papel ventana amarillo tranquilo".split()
    learned = [" ".join(draw.choice(words, 80)) for words in (WORDS, WOERTER, palabras) for _ in range(20)]
    mixed = " ".join(" ".join(draw.choice(words, 20)) for words in (WORDS, WOERTER, palabras))
    nonsense = " ".join("".join(draw.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(60))
    russian = "все счастливые семьи похожи друг на друга каждая несчастливая семья несчастлива по своему"
    texts = [*learned, mixed, "river", nonsense, russian]
    docs = docs_of(texts, langs=[*["en"] * 20, *["de"] * 20, *["es"] * 20, None, None, None, None])
    kept = {r["text"] for r in pipeline.identify_language(spark, docs, "").collect()}
    assert kept == set(texts) - {nonsense, russian}


def test_all_stages_take_empty_tables(spark, docs_of, tmp_path):
    docs = corpus(docs_of).limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_run_is_the_stages_in_turn(spark, small_tables):
    rows = pipeline.run(spark, small_tables).collect()
    assert [name for name, _ in pipeline.STAGES] == ["language", "lines", "near duplicates", "mixing", "packing"]
    total = sum(r["length"] for r in rows)
    places = np.concatenate([r["sequence_id"] * 2048 + r["offset"] + np.arange(r["length"]) for r in rows])
    assert sorted(places) == list(range(total))

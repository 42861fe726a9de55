"""Bounds and hot keys of the corpus operators, and the pipeline against brute force."""

import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborlens.llm.bpe import bpe_decode, bpe_encode
from harborlens.llm.decontaminate import _blocks, benchmark_spans
from harborlens.llm.exact_dedup import exact_dedup
from harborlens.llm.line_dedup import line_dedup
from harborlens.llm.quality import fit_quality
from harborlens.llm.queries import tokenizer_file
from harborlens.llm.sharding import shard
from harborlens.llm.simhash import fingerprint, near_duplicates
from harborlens.llm.warc import BadRecord, member, read_records, read_warc, write_warc


def prose(rng, n):
    return " ".join(rng.choice("tana loso miku repe sana tiso noku lepe mira sota kuna pelo".split()) + rng.choice(["", "r", "n", "st"]) for _ in range(n))


def test_lines_in_many_partitions(spark):
    rng = random.Random(1)
    lines = [prose(rng, 6) for _ in range(20)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = ({tuple(r) for r in line_dedup(df, positions=n).collect()} for n in (10**6, 20))
    assert few == many and sum(r[2] for r in few) > 100


def test_blocks_of_items(spark):
    """Items twice over are one; blocks keep to their size but for one item; each item is in one block."""
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randrange(1, 60))) for i in range(80)]
    df = spark.createDataFrame(items * 3 + [(None, "x"), (99, None)], "item_id long, text string")
    blocks = [b.value for b in _blocks(df, "item_id", "text", 2_000)]
    assert sorted(x for b in blocks for x in b) == sorted((str(i), t) for i, t in items)
    longest = max(len(t) for _, t in items)
    assert len(blocks) > 5 and all(sum(len(t) for _, t in b) <= 2_000 + longest for b in blocks)
    assert [b.value for b in _blocks(df.limit(0), "item_id", "text", 2_000)] == [[]]


def test_many_blocks_over_rows_in_any_order(spark):
    """One pass: rows that come in another order each time they are read have one result each, whatever the blocks."""
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(5, 40))) for i in range(40)]
    rows = [(i % 50, prose(rng, 20) + " " + (rng.choice(items)[1] if i % 3 else "") + " " + (rng.choice(items)[1] if i % 2 else "")) for i in range(120)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand()).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    told = lambda **kw: Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.starts), tuple(r.ends), tuple(r["items"])) for r in benchmark_spans(docs, bench, **kw).collect())
    assert told() == told(block_bytes=300, held_bytes=2_000) == told(block_bytes=300)


def test_a_hot_payload_is_dealt(spark, tmp_path):
    rows = [(i if i % 2 else None, "u", "<p>hot</p>" if i % 3 else f"<p>{i}</p>") for i in range(9_000)]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = read_warc(spark, str(tmp_path / "w"), with_payload=False)
    assert got.count() == len(rows) and got.where("not ok").count() == 0
    ids = [i for i, _, h in rows if h == "<p>hot</p>" and i is not None]
    assert got.where(f"record_type = 'revisit' and refers_to <> '<urn:x-page:{min(ids)}>'").count() == 0
    assert got.where("record_type = 'response' and payload_bytes = 10").count() == 1 + sum(len(h) == 10 and h != "<p>hot</p>" for _, _, h in rows)


def test_an_http_head_has_a_bound():
    block = b"x" * (3 << 20)
    raw = b"WARC/1.1\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    with pytest.raises(BadRecord, match="HTTP head"):
        list(read_records([member(raw)], with_payload=False))
    plain = raw.replace(b"application/http", b"text/plain")
    assert next(read_records([gzip.compress(plain)]))["payload_bytes"] == len(block)


def test_shards_of_a_fixed_capacity(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(400)) for i in range(3_000)] + [(None, "hot " * 100)] * 900 + [(5_000, None)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), None, capacity=20_000, pieces=4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(len(by)))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    sizes = sorted(sum(r.size for r in s) for s in by.values())
    assert sizes[-1] == 900 * 408 and sizes[-2] <= 20_000  # equal texts stay together, and are a shard alone where they must
    total = sum(sizes[:-1])
    assert len(by) - 1 <= 1.3 * total / 20_000 + 4


def test_copies_without_ids_are_dealt(spark):
    """Results of a hot text whose ids are all null."""
    rows = [(None, "hot text of many rows")] * 5_000 + [(i, f"text {i}") for i in range(200)] + [(7_000, "hot text of many rows")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect())
    assert got[None, 7_000, 5_001, False] == 5_000 and got[7_000, 7_000, 5_001, True] == 1 and sum(got.values()) == len(rows)
    near = Counter(r.component_id for r in near_duplicates(df).where("doc_id is null or doc_id = 7000").collect())
    assert near == {7_000: 5_001} or len(near) == 1


def test_decoding_passes_over_unknown_ids(spark):
    ids = spark.createDataFrame([(1, [10, None, 10**8, -3, 20]), (2, None), (3, [])], "doc_id long, ids array<int>")
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_file())
    assert {r.doc_id: r.text for r in bpe_decode(ids, tokenizer_file()).collect()} == {1: t.decode([10, 20], skip_special_tokens=False), 2: "", 3: ""}
    texts = spark.createDataFrame([(1, "Ünï <|endoftext|> x"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in bpe_decode(bpe_encode(texts, tokenizer_file()), tokenizer_file()).collect()} == {1: "Ünï <|endoftext|> x", 2: ""}


def test_pipeline_is_that_of_brute_force(spark, tmp_path):
    """Every stage by plain loops: the classifier's judgement text by text, equal texts, all pairs of fingerprints, all windows, the tokenizers library."""
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(8, 30))) for i in range(6)]
    texts = [prose(rng, rng.randrange(20, 200)).capitalize() + "." for _ in range(90)]
    texts += texts[:10] + [t.replace(" ", "  ", 2) for t in texts[10:20]] + [t + " " + items[k % 6][1] for k, t in enumerate(texts[20:40])]
    texts += [prose(rng, 60).upper().replace(" ", "!! ") for _ in range(12)] + ["", None, "You grobian of groblets " + prose(rng, 20)] + [prose(rng, 25) + " grobian groblet." for _ in range(8)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = spark.createDataFrame([(i, 1, int("grob" in (t or ""))) for i, t in enumerate(texts) if i % 2 == 0], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    model = fit_quality(spark.read.parquet(str(tmp_path / "documents.parquet")), labels=spark.read.parquet(str(tmp_path / "labels.parquet")))
    judged = model.judge([t for _, t, *_ in rows], model.words())
    kept = {i: t or "" for (i, t, *_), (_, p, s) in zip(rows, judged, strict=True) if min(p, s) >= 0.5}
    assert 50 < len(kept) < len(rows)
    last = {t: i for i, t in sorted(kept.items())}
    kept = {i: t for i, t in kept.items() if last[t] == i}
    fps = {i: fingerprint(t) for i, t in kept.items()}
    least = {i: i for i in fps}
    for _ in fps:
        least = {i: min(least[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
    kept = {i: t for i, t in kept.items() if least[i] == i}

    def hits(text):
        ws, marked = text.lower().replace(".", " ").split(), set()
        for _, item in items:
            own = item.split()
            for w in [own] if len(own) < 13 else [own[k : k + 13] for k in range(len(own) - 12)]:
                for p in range(len(ws) - len(w) + 1):
                    if ws[p : p + len(w)] == w:
                        marked.update(range(p, p + len(w)))
        return len(marked), len(ws)

    kept = {i: t for i, t in kept.items() if not (hits(t)[0] and 20 * hits(t)[0] >= hits(t)[1])}
    t = tokenizers.Tokenizer.from_file(tokenizer_file())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, x in kept.items():
        ids = t.encode(x, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 30 < len(want) < len(rows) - 30

"""The registered queries, as they are, on small tables: against their SQL in DuckDB, or against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from harborlens.llm.queries import ORACLES, QUERIES, tokenizer_file
from harborlens.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("tables"), random.Random(3)
    vocabulary = [a + b for a in ("ta", "Lo", "mi", "ré", "SA") for b in ("na", "so", "ku", "pe", "x1")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = prose(30)
    texts = [prose(rng.randrange(5, 120)) + ("\nA line that many share\n" if k % 3 else ".") for k in range(40)]
    texts += [texts[0], texts[0] + " end", None, "", " \n\t", item, prose(200) + " " + item, "Released under the MIT License and GNU Lesser General Public License", "x" * 3000, "idiot scum moron " + prose(9)]
    docs = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "short item Lona"), (3, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    pages = [(k, f"http://x/{k}", t) for k, t in enumerate(["<p>a</p>", "<p>é</p>", "<p>a</p>", None, "", "x" * 100_000])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    spark.createDataFrame([(k, 1, int(k == 49)) for k in range(0, 50, 2)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    roles, said = ["user", "assistant", "system", "", None], ["Yes.", "No", "", " ", "Why?! \n", None]
    turns = [(c, t, roles[rng.randrange(2) if rng.randrange(4) else rng.randrange(5)], said[rng.randrange(6)]) for c in [*range(60), None] for t in rng.sample([*range(8), None], 6)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(folder / "conversations.parquet"))
    return str(folder), docs


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, tables, name):
    folder, _ = tables
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, folder)
    found = c.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(found.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = lambda names, values: Counter(tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in values)
    assert rows(got.columns, got.collect()) == rows(found.columns, found.fetchall())


def test_simhash_query(spark, tables):
    folder, docs = tables
    fps = {i: fingerprint(t) for i, t, *_ in docs}
    component = {i: i for i in fps}
    for _ in fps:  # labels spread until nothing changes
        component = {i: min(component[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, folder).collect()}
    assert got == {i: (f"{fps[i]:016x}", component[i]) for i in fps}


def test_sharding_query(spark, tables):
    folder, docs = tables
    rows = {r.doc_id: r for r in QUERIES["op7_sharding"](spark, folder).collect()}
    assert len(rows) == len(docs)
    for i, t, *_ in docs:
        raw = (t or "").encode()
        assert (rows[i].size, rows[i].text_crc32, rows[i].law, rows[i].grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    for s in range(24):
        slots = sorted(r.slot for r in rows.values() if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in rows.values()} <= set(range(24)) and rows[0].shard == rows[40].shard  # equal texts stay together


def test_bpe_query(spark, tables):
    tokenizers = pytest.importorskip("tokenizers")
    folder, docs = tables
    t = tokenizers.Tokenizer.from_file(tokenizer_file())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_bpe"](spark, folder).collect()}
    for i, text, *_ in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_toxicity_query(spark, tables):
    folder, docs = tables
    got = {r.doc_id: r for r in QUERIES["op13_toxicity"](spark, folder).collect()}
    assert set(got) == {i for i, *_ in docs}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in got.items())


def test_quality_query(spark, tables):
    folder, docs = tables
    got = QUERIES["op4_quality"](spark, folder)
    assert got.count() == len(docs) and got.where("kept and (score < 0.5 or posterior < 0.5)").count() == 0
    assert got.where(F.col("n_words") == 0).agg(F.max("score")).first()[0] == 0

"""The pipeline against SQL and plain Python, stage by stage on the same tables."""

import zlib
from array import array

import corpus_pipeline
import duckdb
from conftest import SF_DIR
from tokenizers import Tokenizer

from tidefeed.llm.oracle import DECONTAMINATE, MIX, near_copies
from tidefeed.llm.tokenstore import default_tokenizer


def expected():
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM read_parquet('{SF_DIR}/documents.parquet')")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF_DIR}/benchmark.parquet')")
    lettered = [i for i, text in con.execute("SELECT doc_id, text FROM documents").fetchall() if any(map(str.isalpha, text or ""))]
    con.execute("DELETE FROM documents WHERE doc_id NOT IN (SELECT unnest(?))", [lettered])
    con.execute(f"CREATE TABLE groups AS {near_copies(5)}")
    con.execute("DELETE FROM documents WHERE doc_id IN (SELECT doc_id FROM groups WHERE NOT kept)")
    con.execute(f"CREATE TABLE hits AS {DECONTAMINATE}")
    con.execute("DELETE FROM documents WHERE doc_id IN (SELECT doc_id FROM hits WHERE contaminated)")
    con.execute(f"CREATE TABLE mixed AS {MIX}")
    rows = con.execute("""SELECT doc_id, text, taken // size FROM documents JOIN mixed USING (doc_id)
      WHERE size > 0 ORDER BY doc_id""").fetchall()
    tokenizer, start, out = Tokenizer.from_file(default_tokenizer()), 0, []
    for doc, text, times in rows:
        ids = array("I", [*tokenizer.encode(text, add_special_tokens=False).ids, 2])
        for _ in range(times):
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    return out


def test_pipeline_result(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    rows = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect())
    assert rows == expected()

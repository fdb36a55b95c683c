"""Null, empty and missing texts in a fresh process, where no table has been made yet."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import tempfile
from siftline.session import build_session
from siftline.llm import collocations, decontam, lexical, neardup, packing, pii, substrings
from siftline.llm.plans import PACK_TOKENIZER
spark = build_session("fresh", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
docs = spark.createDataFrame([(1, None, None), (2, "", "en")], "doc_id long, text string, lang string")
bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string").limit(0)
print("rows", decontam.contamination(docs, bench).count(), pii.personal_data(docs).count(), substrings.repeats(docs).count(), neardup.near_duplicates(docs).count(),
      lexical.top_documents(docs, bench).count(), packing.pack(docs, PACK_TOKENIZER).count(), collocations.collocations(docs).count())
"""


def test_empty_texts_in_a_fresh_process():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=600)
    assert "rows 2 2 2 2 0 2 0" in done.stdout, done.stdout + done.stderr[-3000:]

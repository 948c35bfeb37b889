"""op8: bytes of every document that 100-byte repeats cover."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from sitelens.llm import suffix_dedup as sd
from sitelens.llm.base import register
from sitelens.llm.common import table


def _digest(rows: pa.Table, begins: np.ndarray, ends: np.ndarray, owners: np.ndarray) -> pa.Table:
    out = [
        (len(raw), int((b - a).sum()), len(a), hashlib.sha256(sd.kept_bytes(raw, a, b)).hexdigest())
        for raw, a, b in sd.per_row(rows, "text", begins, ends, owners)
    ]
    n, removed, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table(
        {
            "doc_id": rows.column("doc_id"),
            "n_bytes": pa.array(n, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()),
        }
    )


@register("op8_suffix_dedup")
def op8(spark, sf_dir):
    found = sd.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.apply(_digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")

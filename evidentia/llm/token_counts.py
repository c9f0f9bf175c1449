"""Token counts: a broadcast table of frequent pre-token lengths, then worker caches for the misses."""

from __future__ import annotations

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import doc_text, map_arrow, worker_cache

#: Fixed value: the pre-token pattern of the byte-level tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which this pattern means the same to both regex libraries; texts with others are encoded whole.
PLAIN = regex.compile(r"[^\t\n\r\x20-\x7E\xA0-ɏΑ-ΡΣ-ωА-я‐-‧€]")
#: Entries of the broadcast table, and of a worker's cache before it is emptied.
TABLE_SIZE, CACHE_SIZE = 32_768, 200_000
#: Documents whose pre-tokens choose the table's entries, and their length in characters.  These bounds change speed
#: alone: each length in the table is the library's, and what the table lacks is encoded.
CALIBRATION_DOCS, CALIBRATION_CHARS = 2_048, 8_192


def _tokenizer(spec: str):
    from tokenizers import Tokenizer

    kept = worker_cache("tokenizers")
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in kept:
        kept[key] = (Tokenizer.from_str(spec), {})
    return kept[key]


def _lengths(tokenizer, pieces: list[str]) -> list[int]:
    out: list[int] = []
    for i in range(0, len(pieces), 4096):
        out += [len(x) for x in tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]
    return out


def frequent_lengths(documents: DataFrame, spec: str, table_size: int, calibration_docs: int) -> bytes:
    """The compact table: pre-tokens joined by zero bytes, then their lengths as 16-bit numbers.

    Texts come by ``take``, which reads partitions until it has enough, so the driver gets some MB at any input size.
    """
    find = regex.compile(PRE_TOKEN).findall
    seen: Counter = Counter()
    for row in documents.where(F.length("text") <= CALIBRATION_CHARS).select("text").take(calibration_docs):
        if row.text and not PLAIN.search(row.text):
            seen.update(find(row.text))
    words = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table_size] if len(w) < 200]
    lengths = _lengths(_tokenizer(spec)[0], words)
    return b"\1".join((b"\0".join(w.encode() for w in words), np.array(lengths, "<u2").tobytes())) if words else b""


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 1024, table_size: int = TABLE_SIZE, calibration_docs: int = CALIBRATION_DOCS) -> DataFrame:
    """Tokens of each whole text, as the library counts them without added special tokens.

    A text is split at special strings (one token each, as is the library's default) and into pre-tokens, whose
    lengths add up.  A null or empty text has no bytes and no tokens; doc_id may be null; repeated rows stay.
    Returns doc_id, n_bytes, n_tokens, over_limit.
    """
    documents = doc_text(documents)
    context = documents.sparkSession.sparkContext
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    sent = context.broadcast((spec, frequent_lengths(documents, spec, table_size, calibration_docs)))

    def make():
        spec, packed = sent.value
        tokenizer, cache = _tokenizer(spec)
        if "table" not in cache:
            words, _, lengths = packed.partition(b"\1")
            cache["table"] = dict(zip(words.decode().split("\0"), np.frombuffer(lengths, "<u2").tolist(), strict=True)) if packed else {}
            cache["misses"] = {}
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        return tokenizer, cache["table"], cache["misses"], regex.compile(PRE_TOKEN), regex.compile("|".join(map(regex.escape, special)) or r"(?!)")

    def run(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        tokenizer, table, misses, pattern, special = state
        texts = batch.column("text").to_pylist()
        counts, pending, unknown = [0] * len(texts), [], {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if PLAIN.search(text):
                counts[i] = len(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])
                continue
            parts = [text]
            if "<|" in text:
                parts = special.split(text)
                counts[i] = len(parts) - 1
            for part in parts:
                total = 0
                for word in pattern.findall(part):
                    n = table.get(word) or misses.get(word)
                    if n:
                        total += n
                    else:
                        unknown[word] = 0
                        pending.append((i, word))
                counts[i] += total
        if unknown:
            found = dict(zip(unknown, _lengths(tokenizer, list(unknown)), strict=True))
            for i, word in pending:
                counts[i] += found[word]
            if len(misses) > CACHE_SIZE:
                misses.clear()
            misses.update((w, n) for w, n in found.items() if len(w) < 200)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = documents.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return map_arrow(sized, run, "doc_id bigint, n_bytes bigint, n_tokens bigint", make).withColumn("over_limit", F.col("n_tokens") > limit)

"""Token counts: texts are encoded in Arrow functions that return lengths only.

A task works on texts of about ``BATCH`` bytes at a time and encodes ``CALL`` bytes in one call, whatever the number of
texts, so memory follows the bytes and not the rows. Texts, long ones above all, are cut where the tokenizer cuts too, whatever
stands on either side, so the pieces' counts add up to the text's count:

* The byte-level pre-tokenizer never joins a character that is not white space to white space behind it, and its only look
  ahead is within white space; nor does it join an ASCII letter and an ASCII digit. So a text may be cut before a space or a
  newline that follows a character known to be no white space, and between a letter and a digit.
* No added token of the vocabulary may hold such a place, take in white space beside it, or ask for whole words.

Equal pieces have equal counts, so each is encoded once in a batch, and a worker remembers short ones (``REMEMBERED`` of
them, which decides only how often the library is asked). Where a tokenizer has another pre-tokenizer, a normalizer
or such an added token, and for sentencepiece models, no place is known to be safe and texts are encoded whole. A stretch
without a safe place is one piece, however long.

Files that end in .json belong to the library tokenizers, those in .model to sentencepiece; both run with one thread in each
task. No tokens are added at a text's ends, nothing is truncated or padded, and strings of special tokens within a text are
treated as the library's default does.

Edge cases: a null text counts as empty, which has no bytes and no tokens. Rows are handled one by one, so null ids, ties and
repeated rows need no care. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, byte_sizes, read

#: Bytes of texts that are worked on at a time, and of pieces that are encoded in one call.
BATCH, CALL = 1 << 22, 1 << 20
LIMIT = 1024
#: Pieces whose counts a worker remembers, and their longest.
REMEMBERED, SHORT = 300_000, 32

_BYTES = np.arange(256)
_BREAK = np.isin(_BYTES, (0x20, 0x0A))
_ASCII = (_BYTES >= 0x21) & (_BYTES <= 0x7E)
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
_LETTER = ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A)
_TAIL = (_BYTES >= 0x80) & (_BYTES <= 0xBF)
#: First bytes of characters of two (U+00C0 to U+07FF) and three bytes (U+4000 to U+DFFF) of which none is white space.
_LEAD2, _LEAD3 = (_BYTES >= 0xC3) & (_BYTES <= 0xDF), (_BYTES >= 0xE4) & (_BYTES <= 0xED)


def safe_places(raw: np.ndarray) -> np.ndarray:
    """Places before which UTF-8 bytes may be cut."""
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    left, right = raw[:-1], raw[1:]
    solid, tail = _ASCII[left], _TAIL[left]
    solid[1:] |= tail[1:] & _LEAD2[raw[:-2]]
    solid[2:] |= tail[2:] & tail[1:-1] & _LEAD3[raw[:-3]]
    cut = solid & _BREAK[right]
    cut |= _LETTER[left] & _DIGIT[right]
    cut |= _DIGIT[left] & _LETTER[right]
    return np.flatnonzero(cut) + 1


def may_be_cut(spec: dict) -> bool:
    """Whether a tokenizer (the content of its .json file) cuts at every safe place."""
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return plain and not spec.get("normalizer") and not any(
        t.get("lstrip") or t.get("rstrip") or t.get("single_word") or len(safe_places(np.frombuffer(t["content"].encode(), np.uint8))) for t in spec.get("added_tokens") or []
    )


def encoder(path: str):
    """(function from texts to numbers of tokens, whether texts may be cut) of a vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
    import os

    # Spark gives each task a core of its own
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    encode = getattr(model, "encode_batch_fast", model.encode_batch)
    return (lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]), may_be_cut(json.loads(Path(path).read_text()))


def counter(path: str, call_bytes: int = CALL):
    """A function from UTF-8 texts to their numbers of tokens."""
    lengths, cut = encoder(path)
    known: dict[bytes, int] = {}

    def ask(pieces: list[bytes]) -> list[int]:
        out: list[int] = []
        for a, b in batches_of([len(x) for x in pieces], call_bytes):
            out += lengths([x.decode("utf-8", "replace") for x in pieces[a:b]])
        return out

    def count(texts: list[bytes]) -> np.ndarray:
        if not cut:
            return np.array(ask(texts), np.int64)
        sizes = np.array([len(x) for x in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(texts), np.uint8)
        marks = np.zeros(len(raw) + 1, bool)
        marks[safe_places(raw)] = marks[starts] = marks[-1] = True
        places = np.flatnonzero(marks)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode()
        kinds = pieces.dictionary.to_pylist()
        number = np.fromiter(map(known.get, kinds, repeat(-1)), np.int64, len(kinds))
        new = np.flatnonzero(number < 0)
        asked = [kinds[k] for k in new.tolist()]
        number[new] = ask(asked)
        if len(known) + len(asked) > REMEMBERED:
            known.clear()
        known.update((x, n) for x, n in zip(asked, number[new].tolist(), strict=True) if len(x) <= SHORT)
        total = np.concatenate(([0], np.cumsum(number[pieces.indices.to_numpy()])))
        return total[np.searchsorted(places, starts + sizes)] - total[np.searchsorted(places, starts)]

    return count


#: The counters of this worker, by file.
_COUNTERS: dict = {}


def _counts(tokenizer: str, batch_bytes: int):
    def run(batches):
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = str(public_tokenizers.path(tokenizer))
        if path not in _COUNTERS:
            _COUNTERS[path] = counter(path)
        count = _COUNTERS[path]
        for batch in batches:
            column, ids = batch.column("text").fill_null("").cast(pa.large_binary()), batch.column("doc_id")
            sizes = byte_sizes(column)
            for first, end in batches_of(sizes, batch_bytes):
                total = count(column.slice(first, end - first).to_pylist())
                yield pa.record_batch([ids.slice(first, end - first), pa.array(sizes[first:end], pa.int64()), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    ``tokenizer`` is the name of a public vocabulary, or the path of a file that all executors have.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counts(tokenizer, batch_bytes), f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))

"""Token counts of whole texts, by the library of a vocabulary file: ``tokenizers`` for .json, ``sentencepiece`` for .model.

Texts are encoded in batches of about equal bytes inside an Arrow function that returns lengths only. File splits balance the bytes of tasks; inside
a task, texts longer than ``CHUNK`` characters are split where no token can span, and their parts' lengths added:

* sentencepiece: between two characters that stand side by side in no piece, the first of which is a piece itself. Parts after the first are encoded
  without the space that is put before a text. Models that rewrite texts (a normalizer other than the identity) get whole texts.
* tokenizers: before a single space between other characters, if words are split by the byte-level rule, which starts a new word there. Files with a
  normalizer, another split or added tokens with spaces get whole texts.

A text without such a place is one part. Null texts are empty and have no tokens; rows without an id and repeated rows are counted as they
come. Other columns are not read, whatever their names. Empty tables give empty results. The job has one stage, no shuffle and no state.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.session import table

QUERY = "op11_token_counts"
ORACLE_SQL = None
LIMIT = 4096
CHUNK = 1 << 16
BATCH_BYTES = 1 << 20
#: White space as regular expressions of both libraries' vocabularies read it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = "\u2581"  # how sentencepiece writes a space
_NO_PREFIX = b"\x1a\x02\x18\x00"  # a normalizer_spec message that only sets add_dummy_prefix to false
_PROBE = "  a\tb  \ufb01\uff21 e\u0301\u3000\x00\x1f\n\n\u200bz  "


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A sentencepiece model; ``inside`` has the pairs of characters that some piece holds side by side."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        self.first = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.rest = sentencepiece.SentencePieceProcessor(model_proto=proto + _NO_PREFIX)
        shown = _PROBE.replace(" ", SPACE)
        self.plain = self.rest.normalize(_PROBE) == shown and self.first.normalize(_PROBE) in (shown, SPACE + shown)
        model = self.first
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.single = {p for p in pieces if len(p) == 1}

    def safe(self, text: str, start: int) -> int:
        """The first place from ``start`` on where the text may be split, or its end."""
        if not self.plain:
            return len(text)
        before = text[start - 1].replace(" ", SPACE)
        for i in range(start, len(text)):
            here = text[i].replace(" ", SPACE)
            if before in self.single and before + here not in self.inside:
                return i
            before = here
        return len(text)

    def lengths(self, parts: list[str], heads: list[bool]) -> list[int]:
        out = [0] * len(parts)
        for model, wanted in ((self.first, True), (self.rest, False)):
            at = [i for i, h in enumerate(heads) if h == wanted]
            for i, ids in zip(at, model.encode([parts[i] for i in at], num_threads=1), strict=True):
                out[i] = len(ids)
        return out


class Words:
    """A ``tokenizers`` file."""

    _PLACE = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split, added = file.get("pre_tokenizer") or {}, file.get("added_tokens") or ()
        self.plain = (
            not file.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
            and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")) and not any(re.search(f"[{WHITE}]", t["content"]) for t in added)
        )

    def safe(self, text: str, start: int) -> int:
        found = self._PLACE.search(text, start) if self.plain else None
        return found.start() if found else len(text)

    def lengths(self, parts: list[str], heads: list[bool]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(parts, add_special_tokens=False)]


_OPEN: dict[str, Pieces | Words] = {}


def tokenizer(path: str) -> Pieces | Words:
    if path not in _OPEN:
        _OPEN[path] = Pieces(path) if path.endswith(".model") else Words(path)
    return _OPEN[path]


def parts(model: Pieces | Words, text: str, chunk: int = CHUNK) -> Iterator[str]:
    """The text in parts of ``chunk`` characters and what follows up to the next safe place."""
    at = 0
    while len(text) - at > chunk:
        end = model.safe(text, at + chunk)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of every row."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = tokenizer(path)
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            rows, held, heads, size = [], [], [], 0

            def flush() -> None:
                np.add.at(n, rows, opened.lengths(held, heads))  # noqa: B023
                rows.clear(), held.clear(), heads.clear()  # noqa: B023

            for i, value in enumerate(b.column(1)):
                for k, part in enumerate(parts(opened, value.as_py() or "", chunk)):
                    rows.append(i)
                    held.append(part)
                    heads.append(k == 0)
                    size += len(part)
                    if size >= BATCH_BYTES:
                        flush()
                        size = 0
            if held:
                flush()
            n_bytes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))

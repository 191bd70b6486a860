"""Token counts of a byte-level BPE tokenizer with a whole-token shortcut.

Before the scan, every vocabulary string is put through the tokenizer alone; those that come back as their own single id, and
that pre-tokenization leaves in one piece, form the proven set. In the scan a text is cut into pre-tokens; a pre-token of
the proven set counts 1 without any merging, and only the others are merged by the tokenizer, each distinct one once
per task while the memo, of bounded size, holds it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masklake.llm.common import bound_batches, id_and_text, pieces

LIMIT = 1024
MEMO = 400_000
_LONGEST_MEMO = 64

#: Fixed value: the published pre-token pattern of the byte-level tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Blocks of long-settled scripts; a text with a code point outside them is cut by the library's pre-tokenizer.
AGREED = [(0x0, 0x52F), (0x1E00, 0x206F), (0x20A0, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
          (0x1F300, 0x1F64F)]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest is moved beyond 255 in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


def classes_agree(spec: str, ranges: list[tuple[int, int]]) -> bool:
    """Whether the pattern here and the library's own pre-tokenizer class every code point of the ranges alike.

    The two may follow different versions of Unicode, so this is proven offline (a test runs it over `AGREED`).
    """
    from tokenizers import Tokenizer

    own, pattern = Tokenizer.from_str(spec).pre_tokenizer, regex.compile(PRE_TOKEN)
    for low, high in ranges:
        for at in range(low, high + 1, 512):
            text = "".join(f"a{c}1{c}!{c} " for c in map(chr, range(at, min(at + 512, high + 1))))
            if [span for _, span in own.pre_tokenize_str(text)] != [m.span() for m in pattern.finditer(text)]:
                return False
    return True


@lru_cache(maxsize=4)
def prove_whole_tokens(spec: str) -> frozenset[str]:
    """Vocabulary strings that, met as a pre-token, are exactly one token."""
    from tokenizers import Tokenizer

    tokenizer, alphabet, pattern = Tokenizer.from_str(spec), byte_alphabet(), regex.compile(PRE_TOKEN)
    special = {t["content"] for t in json.loads(spec)["added_tokens"]}
    texts: dict[str, int] = {}
    for token, number in json.loads(spec)["model"]["vocab"].items():
        try:
            text = bytes(alphabet[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text not in special and (found := pattern.match(text)) and found.end() == len(text):
            texts[text] = number
    encoded = tokenizer.encode_batch(list(texts), add_special_tokens=False)
    return frozenset(t for (t, number), e in zip(texts.items(), encoded, strict=True) if e.ids == [number])


class _Counts(dict):
    """Tokens of a pre-token; those missing are merged by the tokenizer."""

    def __init__(self, tokenizer, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.tokenizer, self.whole = tokenizer, whole

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)  # a pre-token stays one piece alone
        if len(piece) <= _LONGEST_MEMO:
            if len(self) > MEMO + len(self.whole):
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, n_whole (pre-tokens counted by the shortcut), over_limit (n_tokens > limit).

    Counts are the library's, special strings inside texts included, without begin, end or added tokens. Null and empty texts
    have 0 tokens. Rows are kept one for one, repeated rows too; other columns are not read. Texts of any length are
    counted whole. The tokenizer's file is read by the driver alone and sent to the tasks (its size is fixed).
    """
    bound_batches(docs.sparkSession)
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    parts = json.loads(spec)
    if parts["pre_tokenizer"] != parts["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or parts["normalizer"]:
        raise ValueError("the shortcut is proven for byte-level tokenizers without normalizer and prefix space")
    special = [t["content"] for t in parts["added_tokens"]]
    shared = docs.sparkSession.sparkContext.broadcast((spec, prove_whole_tokens(spec)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        spec, whole = shared.value
        tokenizer = Tokenizer.from_str(spec)
        counts, findall = _Counts(tokenizer, whole), regex.compile(PRE_TOKEN).findall
        has_other = regex.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in AGREED) + "]").search

        def cut(text: str) -> list[str]:
            if text.isascii() or not has_other(text):
                return findall(text)
            return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

        for batch in pieces(batches, "text"):
            tokens, short = [], []
            for text in batch.column("text").to_pylist():
                n = direct = 0
                for k, part in enumerate(_between(text, special)):
                    n += k > 0
                    found = cut(part)
                    n += sum(map(counts.__getitem__, found))
                    direct += sum(map(whole.__contains__, found))
                tokens.append(n)
                short.append(direct)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                                   "n_tokens": pa.array(tokens, pa.int64()), "n_whole": pa.array(short, pa.int64())})

    rows = id_and_text(docs).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_whole bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _between(text: str, special: list[str]) -> list[str]:
    """The text cut at special strings, each of which is one token; the earliest and then the longest comes first."""
    if not any(s in text for s in special):
        return [text]
    return regex.split("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)), text)

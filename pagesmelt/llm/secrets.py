"""Operator 10: secrets in texts.

An Aho-Corasick automaton finds the keywords of all kinds in one pass; regular expressions are tried
only where a keyword stands.  Runs of hexadecimal digits have no keyword: a run of 32 covers four
places in a row of every eighth, so only there a run is measured.  Access tokens that carry a
checksum are kept only if it holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmelt.llm import common
from pagesmelt.llm.common import per_batch

# The kinds in the order of their spans, their patterns and lengths.
KINDS = ("assign", "access", "hex", "token")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# Published format: a prefix, thirty characters and their CRC-32 in six base-62 digits.
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
}
VALUE_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
REDACTED = "[REDACTED]"
#: Texts that are masked at a time, whatever the Arrow batch.
BATCH_ROWS = 256

IS_HEX = np.zeros(256, dtype=bool)
IS_HEX[list(b"0123456789abcdef")] = True


def keyword_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def checksum_holds(body: str, check: str) -> bool:
    number, digits = zlib.crc32(body.encode()), ""
    for _ in range(len(check)):
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits == check


def hex_runs(text: str, raw: bytes) -> list[tuple[int, int]]:
    """Runs of 32 or more hexadecimal digits, as code points of ``text``; ``raw`` is its UTF-8."""
    sample = IS_HEX[np.frombuffer(raw, dtype=np.uint8)[::8]]
    if len(sample) < 4 or not (sample[:-3] & sample[1:-2] & sample[2:-1] & sample[3:]).any():
        return []
    return [hit.span() for hit in HEX.finditer(text)]


def find_spans(text: str | None, automaton) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of all secrets, by start and then kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    folded = raw.lower().decode()  # letters beyond ASCII, and all places, stay as they are
    near: dict[str, list[int]] = {kind: [] for kind in KINDS}
    for end, (kind, length) in automaton.iter(folded):
        near[kind].append(end + 1 - length)
    spans = [(start, "hex", end) for start, end in hex_runs(text, raw)]
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("token", TOKEN)):
        free = 0
        for start in sorted(near[kind]):
            hit = pattern.match(text, start) if start >= free else None
            if hit is None:
                continue
            free = hit.end()
            if kind == "assign":
                good = len(hit.group(2)) >= VALUE_LENGTH
            elif kind == "access":
                good = len(hit.group()) >= ACCESS_LENGTH
            else:
                good = checksum_holds(*hit.groups())
            if good:
                spans.append((start, kind, free))
    return sorted(spans, key=lambda span: (span[0], KINDS.index(span[1])))


def scan_secrets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """The id and ``spans``, an array of ``start``, ``kind`` and ``end`` (code points, exclusive).

    Narrow: no shuffle.  Null and empty texts have no spans; repeated rows stay; other columns are
    not read.
    """
    def work(batch: dict) -> dict:
        automaton = keyword_automaton()
        return {"_id": batch["_id"], "spans": [
            [{"start": start, "kind": kind, "end": end}
             for start, kind, end in find_spans(text, automaton)] for text in batch["_text"]]}

    kind = dict(docs.dtypes)[id_column]
    return per_batch(
        docs.selectExpr(f"`{id_column}` AS _id", f"`{text_column}` AS _text"),
        f"_id {kind}, spans array<struct<start:int,kind:string,end:int>>",
        work).withColumnRenamed("_id", id_column)


def span_digest(base_only: bool) -> str:
    """SQL: the spans as kind:start:end, comma-joined."""
    names = ", ".join(f"'{kind}'" for kind in (BASE_KINDS if base_only else KINDS))
    return (
        f"concat_ws(',', transform(filter(spans, s -> s.kind IN ({names})), "
        "s -> concat_ws(':', s.kind, cast(s.start AS string), cast(s.end AS string))))")


def masked(text: str | None, automaton) -> str | None:
    """The text with a mark for each secret; overlapping ones share it."""
    out, at, free = [], 0, 0
    for start, _, end in find_spans(text, automaton):
        if start >= free:
            out += [text[at:start], REDACTED]
        at = free = max(end, free)
    return "".join(out) + text[at:] if out else text


def mask_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``masked`` over Arrow batches of texts, ``BATCH_ROWS`` at a time."""
    automaton = keyword_automaton()
    for texts in batches:
        for start in range(0, len(texts), BATCH_ROWS):
            yield pa.array([masked(text, automaton) for text in
                            texts.slice(start, BATCH_ROWS).to_pylist()], pa.string())


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by a mark; the columns stay as they are.

    Overlapping secrets share one mark; ``n_chars``, if there, is counted anew.  Null and empty texts
    stay as they are.
    """
    mask = F.arrow_udf(mask_batches, "string")
    out = docs.withColumn(text_column, mask(F.col(f"`{text_column}`")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        mark = F.col(f"`{text_column}`")
        out = out.withColumn("n_chars", F.when(
            F.contains(mark, F.lit(REDACTED)), F.length(mark)).otherwise(
            F.col("n_chars")).cast(kind))
    return out


cloudpickle.register_pickle_by_value(common)

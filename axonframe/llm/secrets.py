"""Secret scans: fixed patterns, and strings in a sensitive context that zstandard cannot predict.

A candidate is a long string shortly behind a word such as "key" or "auth". Its novelty is what it adds to the compressed
size of the text around it, under a dictionary of common identifiers: readable identifiers and repeated text add little,
random keys nearly their full entropy. Candidates whose bytes are mostly new are reported beside the patterns' spans.
Candidates of letters or of digits alone must be newer than others, as words of a language that is written together are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import outside, slices, texts_of

KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns and least lengths (of group 2 in the first, else of the match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: Words behind which a candidate may stand.
CONTEXTS = (r"auth\w*", "bearer", "credentials?", "private_?key", "signature", "client_?id", "access_?key", r"secret\w*", "token", r"passw\w*", "api_?key", r"key\s*[:=]")
CONTEXT = re.compile("|".join(CONTEXTS), re.I | re.A)
#: A text without any of these has no span: the fixed patterns' keywords are among the contexts. For a quick first look.
MAYBE = f"(?i:{'|'.join(CONTEXTS)})|AKIA|[0-9a-f]{{16}}"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: How far behind its context word a candidate may start, how much text around it primes the compressor, and the share of its bytes that must be new: where it has letters and digits, and otherwise.
REACH, AROUND, NOVEL_SHARE, PLAIN_SHARE = 40, 400, 0.72, 1.05

IDENTIFIERS = (
    "authorization authentication bearer token access_token refresh_token client_id client_secret credentials private_key public_key signature secret_key api_key "
    "password username session cookie certificate configuration environment production development database connection string localhost example default "
    "application service request response header content-type application/json return function import export const public static void class interface "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 ffffffff xxxxxxxx XXXXXXXX your_key_here changeme placeholder"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind, in code points."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


class Novelty:
    def __init__(self, identifiers: str = IDENTIFIERS):
        dictionary = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=dictionary, write_content_size=False, write_checksum=False)

    def share(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes that the candidate adds to the text around it, per byte of it."""
        around = (before + " " + after).encode()
        added = len(self.compressor.compress(around + candidate.encode())) - len(self.compressor.compress(around))
        return added / len(candidate)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found, last = [], 0
        for m in CONTEXT.finditer(text):
            for c in CANDIDATE.finditer(text, max(last, m.end()), m.end() + REACH + 512):
                if c.start() > m.end() + REACH:
                    break
                whole = CANDIDATE.match(text, c.start())
                last = whole.end()
                mixed = any(x.isdigit() for x in whole[0]) and any(x.isalpha() for x in whole[0])
                if self.share(text[max(0, c.start() - AROUND) : c.start()], whole[0], text[last : last + AROUND]) >= (NOVEL_SHARE if mixed else PLAIN_SHARE):
                    found.append((c.start(), last, 3))
        return found


def find_novel(text: str) -> list[tuple[int, int, int]]:
    """The novel spans of one text, whether or not fixed patterns match there."""
    return Novelty().spans(text)


def all_spans(text: str, novelty: Novelty) -> tuple[list, list]:
    """The fixed patterns' spans, and those with the novel ones, in order of start and kind. A candidate within a fixed span is not a second finding."""
    base = base_spans(text)
    return base, sorted(base + outside(novelty.spans(text), base), key=lambda s: (s[0], s[2]))


def _said(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scan(batches):
    novelty = Novelty()
    for batch in batches:
        for part in slices(batch):
            maybe = np.flatnonzero(pc.match_substring_regex(part.column(1), MAYBE).to_numpy(zero_copy_only=False))
            n = len(part)
            counts, base, every = np.zeros((3, n), np.int64), [""] * n, [""] * n
            for i, text in zip(maybe.tolist(), part.column(1).take(pa.array(maybe)).to_pylist()):
                own, more = all_spans(text, novelty)
                for _, _, k in own:
                    counts[k, i] += 1
                base[i], every[i] = _said(own), _said(more)
            digests = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, counts), pa.array(digests), pa.array(every)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points, ends exclusive. base_sha256 is of the fixed patterns' spans, spans lists these and the novel
    ones as kind:start:end; both are empty lists for a null, empty or harmless text. An empty table gives no rows.
    """
    return texts_of(docs, id_col, text_col).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with each secret span (overlapping ones as one) replaced by mark, n_chars renewed; null texts stay null, other columns as they are, whatever their names. An empty table stays empty."""

    def redacted(batches):
        novelty = Novelty()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                texts = part.column(at)
                maybe = pc.match_substring_regex(texts, MAYBE).fill_null(False)
                new = pa.array([_redacted(t, all_spans(t, novelty)[1], mark) for t in texts.filter(maybe).to_pylist()], pa.string())
                yield part.set_column(at, text_col, pc.replace_with_mask(texts, maybe, new))

    out = docs.mapInArrow(redacted, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out


def _redacted(text: str, spans: list, mark: str) -> str:
    parts, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:]

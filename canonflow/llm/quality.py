"""Line-first quality rules.

Each line is judged by itself: punctuation (a fragment of few words without a
sentence's end), navigation (separators between short labels), symbols (much
of the line is markup) and boilerplate (phrases of page furniture, in short
lines).  Failing lines are removed; a document that thereby loses too much of
its text is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import with_columns
from .words import SPACED, Words, shards, windows

# Characters of the counts.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Phrases of page furniture by language; accents are given in both cases, since case is folded in ASCII alone.
PHRASES = {
    "en": r"all rights reserved|privacy policy|terms of (?:use|service)|cookie (?:policy|settings|preferences)|(?:accept|uses?) (?:all )?cookies|sign (?:in|up)\b|log ?in\b|subscribe (?:to|now)|share (?:this|on)|read more|click here|skip to (?:main )?content|enable javascript|powered by|copyright\b|©|\(c\) ?[0-9]{4}",
    "fr": r"tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|conditions d['’]utilisation|mentions l[éÉ]gales|lire la suite|accepter (?:tous )?les cookies|se connecter\b|partager sur|plan du site",
    "de": r"alle rechte vorbehalten|datenschutzerkl[äÄ]rung|nutzungsbedingungen|impressum|weiterlesen\b|cookies akzeptieren|jetzt anmelden|auf facebook teilen|zum inhalt springen",
    "es": r"todos los derechos reservados|pol[íÍ]tica de privacidad|t[éÉ]rminos (?:de uso|y condiciones)|aviso legal|leer m[áÁ]s|aceptar (?:todas )?las cookies|iniciar sesi[óÓ]n|compartir en|mapa del sitio",
}
BOILERPLATE = re.compile("|".join(PHRASES.values()), re.IGNORECASE | re.ASCII)
ENDS = tuple(".!?…:;\"'”’»)]}。！？")
#: What stands between the labels of a menu.
SEPARATORS = re.compile(r"[|»›•·¦]|::| / ")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1


@dataclass(frozen=True)
class LineRules:
    fragment_words: int = 4
    separators: int = 2
    label_words: int = 4
    symbol_percent: int = 10
    boilerplate_words: int = 15
    lost_percent: int = 50
    least_words: int = 20
    repeat_percent: int = 30


def line_fault(line: str, rules: LineRules) -> str | None:
    """The rule that a line with a word fails, if any."""
    words = len(line.encode().split())  # of bytes, split takes ASCII white space alone
    if words <= rules.fragment_words and not line.rstrip(SPACE).endswith(ENDS):
        return "punctuation"
    found = len(SEPARATORS.findall(line))
    if found >= rules.separators and words - found <= rules.label_words * (found + 1):
        return "navigation"
    symbols = sum(map(line.count, SYMBOLS))
    if symbols and 100 * symbols >= rules.symbol_percent * len(line):
        return "symbols"
    if words <= rules.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def judge_lines(text: str, rules: LineRules) -> tuple[str, int, int, int]:
    """(text without the failing lines, their number, word characters in them, lines equal to an earlier one)."""
    kept, seen, removed, lost, copies = [], set(), 0, 0, 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            copies += line in seen
            seen.add(line)
            if line_fault(line, rules):
                removed += 1
                lost += len(line) - sum(map(line.count, SPACE))
                continue
        kept.append(line)
    return "\n".join(kept) if removed else text, removed, lost, copies


def repeated_words(words: Words, n: int = 8) -> np.ndarray:
    """For each text, the words in windows of n words that the text has twice or more."""
    texts = len(words.first) - 1
    out = np.zeros(texts, np.int64)
    if len(words.hash) < n:
        return out
    owner = np.repeat(np.arange(texts), np.diff(words.first))
    hashes = windows(words.hash, n)
    at = np.flatnonzero(owner[: len(hashes)] == owner[n - 1 :])
    order = at[np.lexsort((hashes[at], owner[at]))]
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    twice = np.zeros(len(order), np.bool_)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words.hash) + 1, np.int64)
    edge[order[twice]] += 1
    ends = np.bincount(order[twice] + n, minlength=len(edge))
    np.add.at(out, owner[np.flatnonzero(np.cumsum(edge - ends)[:-1] > 0)], 1)
    return out


SCHEMA = T.StructType(
    [
        *[T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "lost_chars")],
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def apply_quality_rules(documents: DataFrame, rules: LineRules = LineRules(), text_column: str = "text") -> DataFrame:
    """The columns of `documents` with SCHEMA's columns after them (columns of those names are replaced).

    clean_text is the text without failing lines, in all rows; null for a null text, which has no words and fails the base
    rules, as does an empty text. Words of a 20,000-word or longer text count like any others. Rows are independent, so copies
    and ties don't matter, and an empty table gives an empty result. Windows of words are compared as 64-bit hashes.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        n, columns = len(texts), np.zeros((7, len(texts)), np.int64)
        for at, to, data, offsets in shards(texts):
            words = Words(data, offsets, SPACED)
            counts = np.diff(words.first)
            columns[0, at:to] = counts
            # code points begin at bytes that are not 10xxxxxx
            points = np.concatenate([[0], np.cumsum((words.bytes != 0) & ((data & 0xC0) != 0x80))])
            columns[1, at:to] = points[offsets[1:]] - points[offsets[:-1]]
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
            columns[2, at:to] = symbols[offsets[1:]] - symbols[offsets[:-1]]
            columns[4, at:to] = repeated_words(words)
        clean: list[str | None] = []
        for i, text in enumerate(texts):
            text = text.as_py()
            if text is None:
                clean.append(None)
                continue
            fixed, columns[5, i], columns[6, i], columns[3, i] = judge_lines(text, rules)
            clean.append(fixed)
        failed = (columns[0] < rules.least_words) | (100 * columns[4] > rules.repeat_percent * columns[0])
        kept = ~failed & (100 * columns[6] <= rules.lost_percent * columns[1])
        assert len(clean) == n
        return [*map(pa.array, columns), pa.array(failed), pa.array(kept), pa.array(clean, pa.string())]

    return with_columns(documents, text_column, SCHEMA, compute)

"""Line-first quality rules: failing lines are removed, then documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashes, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Ends that make a line a sentence, closing quotes and brackets aside.
SENTENCE_END = (".", "!", "?", "…", ":", ";", "。", "！", "？", "।", "؟")
CLOSING = "\"'»”’)]}›"
#: Phrases of page furniture, lower case, in English, German, French and Spanish: those that a sentence hardly holds, and
#: those that only make a short line furniture
#: (SHORT_LINE words, or SHORT_WHOLE that end like a sentence).
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses? cookies|accept (?:all )?cookies|(?:enable|requires?) javascript|javascript (?:is |must be )?(?:disabled|required|enabled)|"
    r"licensed under|copyright (?:©|\(c\)|[12][0-9]{3})|©|subscribe to (?:our|the|this)|powered by|lorem ipsum|back to top|skip to (?:main )?content|"
    r"alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl[äa]rung|cookie-richtlinie|verwende[tn] cookies|(?:alle )?cookies (?:akzeptieren|zulassen)|javascript aktivieren|lizenziert unter|zum seitenanfang|zum inhalt springen|"
    r"tous droits r[ée]serv[ée]s|conditions d['’]utilisation|politique de confidentialit[ée]|mentions l[ée]gales|utilise(?:ns)? des cookies|(?:accepter|autoriser) (?:tous )?les cookies|activer javascript|sous licence|retour en haut|aller au contenu|"
    r"todos los derechos reservados|t[ée]rminos (?:de uso|del servicio)|condiciones de uso|pol[íi]tica de (?:privacidad|cookies)|utiliza(?:mos)? cookies|aceptar (?:todas )?las cookies|(?:active|habilite) javascript|bajo licencia|volver arriba|ir al contenido"
)
FURNITURE = re.compile(
    r"copyright|javascript|subscribe|sign up|log in|log out|click here|read more|share this|skip to|newsletter|"
    r"anmelden|registrieren|abonnieren|hier klicken|mehr lesen|weiterlesen|teilen|impressum|"
    r"s['’]inscrire|se connecter|s['’]abonner|cliquez ici|lire la suite|en savoir plus|partager|"
    r"reg[íi]strese|iniciar sesi[óo]n|suscr[íi]base|haga clic|leer m[áa]s|compartir"
)
SHORT_LINE, SHORT_WHOLE = 8, 4
NAVIGATION = re.compile(r"(?:^|\s)(?:[|»›>•·/]|-{1,2}>|::)(?:\s|$)")
#: Shares of a line's words.
MAX_SEPARATORS, MAX_SYMBOL_WORDS, MAX_UPPER, MAX_STUTTER = 0.2, 0.3, 0.6, 0.3
SEPARATOR, SYMBOL = re.compile(r"[|»›>•·/:]"), re.compile(r"[#*$%&|<>]")
#: Bytes of ASCII capitals and of all other scripts.
NOT_LOWER = bytes([*range(0x41, 0x5B), *range(0x80, 0x100)])
#: A line without a sentence's end is kept if it has so many words and lower-case text.
LONG_LINE = 12
#: Share of a document's word characters that must be left.
MIN_LEFT = 0.5
CHUNK = 1 << 16


@dataclass
class Rules:
    """Parameters of the rules, with the production values."""

    min_left: float = MIN_LEFT
    min_words: int = MIN_WORDS
    max_repeat_percent: int = MAX_REPEAT_PERCENT


def line_fails(line: str) -> str | None:
    """Name of the rule that a line with words fails, or None."""
    found = line.split()
    n = len(found)
    if n > 2 and SEPARATOR.search(line) and len(NAVIGATION.findall(line)) > n * MAX_SEPARATORS:
        return "navigation"
    if SYMBOL.search(line) and sum(1 for w in found if SYMBOL.search(w)) > MAX_SYMBOL_WORDS * n:
        return "symbols"
    if n >= 4 and _may_shout(line) and sum(1 for w in found if w.isupper() and len(w) > 1) > MAX_UPPER * n:
        return "shouting"
    if n >= 6 and sum(map(eq, found, found[1:])) > MAX_STUTTER * n:
        return "stutter"
    if n < 40 and (BOILERPLATE.search(low := line.lower()) or FURNITURE.search(low) and n <= (SHORT_WHOLE if _ends_sentence(line) else SHORT_LINE)):
        return "boilerplate"
    if n >= LONG_LINE or _ends_sentence(line):
        return None
    return "punctuation"


def _ends_sentence(line: str) -> bool:
    return line.rstrip().rstrip(CLOSING).endswith(SENTENCE_END)


def _may_shout(line: str) -> bool:
    """False only for lines with too few capitals for the rule: a quick look before words are counted."""
    raw = line.encode()
    return 10 * (len(raw) - len(raw.translate(None, NOT_LOWER))) > len(raw)


def repeated_words(tokens: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of `window` words that occur more than once, the first time included.

    Window hashes find the candidates, their words decide."""
    n = len(tokens) - window + 1
    if n < 2:
        return 0
    joined, ends, at = b" ".join(tokens), [], -1
    for token in tokens:
        at += len(token) + 1
        ends.append(at)
    starts = [0, *(end + 1 for end in ends)]
    h = np.empty(n, np.uint64)
    for a in range(0, n, CHUNK):
        b = min(a + CHUNK, n)
        h[a:b] = hashes([joined[s:e] for s, e in zip(starts[a:b], ends[a + window - 1 : b + window - 1])])
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    again = np.nonzero(counts[inverse] > 1)[0]
    if not len(again):
        return 0
    met: dict[bytes, int] = {}
    cover = np.zeros(len(tokens) + 1, np.int32)
    for i in again.tolist():
        key = joined[starts[i] : ends[i + window - 1]]
        first = met.setdefault(key, i)
        if first != i:
            for k in (first, i):
                cover[k] += 1
                cover[k + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measures(text: bytes | None, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines, failed lines, share left,
    clean text) of a text."""
    raw = text or b""
    tokens = words(raw)
    n_words = len(tokens)
    word_chars = len(raw.decode("utf-8", "replace")) - sum(raw.count(c) for c in b" \t\n\v\f\r")
    n_symbols = sum(raw.count(c) for c in SYMBOLS)
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup = with_words = failed = left = 0
    clean = []
    for line in lines:
        if not line.split():
            clean.append(line)
            continue
        with_words += 1
        if line in seen:
            dup += 1
        seen.add(line)
        shown = line.decode("utf-8", "replace")
        if line_fails(shown) is None:
            left += len(shown) - sum(shown.count(c) for c in " \t\v\f\r")
            clean.append(line)
        else:
            failed += 1
    repeat = repeated_words(tokens)
    base_failed = n_words < rules.min_words or 100 * repeat > rules.max_repeat_percent * n_words
    share = left / word_chars if word_chars else 0.0
    return n_words, word_chars, n_symbols, dup, repeat, base_failed, not base_failed and share >= rules.min_left, with_words, failed, share, b"\n".join(clean).strip()


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "share_left", "clean_text")
TYPES = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary())


def evaluate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None, with_text: bool = True) -> DataFrame:
    """(id_col, the columns FIELDS) for every row; clean_text is the text without the lines that fail a rule.

    Rules are evaluated for every line that has a word, then the document: it is kept if it passes the base rules
    (enough words, few repeated ones) and enough of its word characters are on lines that pass. Null and empty texts
    have no words and fail. Rows are independent, equal rows give equal results; one narrow pass, no shuffle.
    """
    rules, names = rules or Rules(), FIELDS if with_text else FIELDS[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(text.as_py(), rules) for text in batch.column(1)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(TYPES[: len(names)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, share_left double"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = source.mapInArrow(run, schema + (", clean_text binary" if with_text else ""))
    return (out.withColumn("clean_text", F.col("clean_text").cast("string")) if with_text else out).withColumnRenamed("id", id_col)

"""Per-document text statistics from chunk counts that can be merged in any grouping.

A huge text is cut into chunks that know a fixed number of characters on either side (CONTEXT). Whatever is decided
within that reach is decided by the chunk that holds it: tags, sentence ends, list marks, words and common words. What has no bound
crosses cuts as state: the line and the piece of text that are still open on either edge. Merging two neighbours adds the
counts and joins the open line and piece, so chunks merge in a tree and any cuts give the counts of the whole text.
Texts of one chunk need no shuffle. Ratios and the rules that tell prose from lists, tables and junk come from the merged counts.

A *word* is a run of characters without white space, and each Chinese character is one. A *common word* is one that the list
has, of at most 64 characters with the marks around it. A *line* ends at a line feed; blank lines do not count. Tags are taken out of the text, which
is then cut into pieces: a *sentence* ends with a full stop, question or exclamation mark before white space (Chinese ones
anywhere); blank lines, list marks, cells and table tags end a piece that is none. A sentence is *readable* if it has few
odd symbols and several lower-case words (or Chinese characters with a common word) and is not longer than any sentence in
prose. The *prose share* is the readable sentences' share of all characters outside tags.
"""

from __future__ import annotations

import pickle
import re
import sys
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 65_536
#: Characters a chunk knows on either side; more than the longest tag and the furthest a boundary looks ahead together.
CONTEXT = 640
#: Characters, with single blanks, of the longest sentence in prose.
LONGEST = 900
LONGEST_WORD = 64
PUNCTUATION = "\"'“”‘’()[]{}<>.,;:!?…、，。！？；：「」『』（）"
LINE_ENDS = frozenset(".!?。！？;；:：…\"”’」』")
CLOSERS = "\"”’)]」』）"
ENDS = frozenset(".!?。！？")
CJK = re.compile("[㐀-鿿豈-﫿]")
#: A tag has at most 303 characters; those in the group end a piece, as the parts of tables and lists do.
TAG = re.compile(r"</?(?:((?:t[dhr]|table|tbody|thead|li|ul|ol|pre)\b)|[a-zA-Z!])[^<>]{0,300}>")
#: What stands for a tag that is taken out: both are white space, the second one ends a piece.
GAP, BREAK = "\x1f", "\x1e"
#: What ends a piece, one character each; all look ahead by at most 201 characters.
BOUND = re.compile(r"""[.!?](?=["”’)\]」』）]{0,4}\s)|[。！？\t\x1e]|\n(?=[ \t\r]{0,200}\n|[ \t]{0,40}(?:[-*•·–—▪◦‣|+]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)])[ \t])""")
#: Closing marks left over from the sentence before.
LEFT_OVER = re.compile(r"""(?:[”’)\]」』）]|["'](?=[\s"'”’)\]」』）]|$))+""")
ODD = re.compile("[{}|~^#\\\\*`<>@_\u0080-\u009f�]")
NAME = re.compile("[A-Za-z]_[A-Za-z]")
RUN = re.compile(r"\S*")

#: Fixed order of the counts that simply add up.
COUNTS = ("chars", "letters", "digits", "symbols", "cjk", "tag_chars", "words", "word_chars", "common", "lines", "punct_lines", "sentences", "prose_chars")
STATE = ("counts", "head", "last", "line_l", "line_r", "broken")


def _classes() -> np.ndarray:
    """The class of each code point: 0 white space, 1 letter, 2 digit, 3 symbol, 4 Chinese."""
    known = sys.__dict__.setdefault("_char_classes", {})
    if "table" not in known:
        table = np.full(0x110000, 3, np.uint8)
        for c in range(0x30000):
            s = chr(c)
            if 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF:
                table[c] = 4
            elif s.isspace():
                table[c] = 0
            elif s.isalpha():
                table[c] = 1
            elif s.isdigit():
                table[c] = 2
        known["table"] = table
    return known["table"]


class Lexicon:
    """Common words: those of Latin script are looked up as whole words, the others by the characters they start at."""

    def __init__(self, words: Iterable[str]):
        words = [w.strip().lower() for w in words if w and w.strip()]
        words = [w for w in words if len(w) <= LONGEST_WORD]
        self.latin = frozenset(w for w in words if not CJK.search(w))
        self.other = sorted({w for w in words if CJK.search(w)}, key=len, reverse=True)
        self.starts = re.compile("(?=" + "|".join(map(re.escape, self.other)) + ")") if self.other else None


def readable(piece: str, lexicon: Lexicon) -> int:
    """How many characters (without white space) a piece has that ends like a sentence, if it reads like one; else 0."""
    tokens = piece.split()
    n = sum(map(len, tokens))
    cjk = 0 if piece.isascii() else len(CJK.findall(piece))
    if cjk >= 5 and cjk > 0.3 * n:
        return n if cjk >= 10 or lexicon.starts and lexicon.starts.search(piece) else 0
    if len(tokens) < 3:
        return n if len(tokens) == 2 and tokens[0].isalpha() and tokens[1][:-1].islower() and tokens[1][:-1].isalpha() else 0
    lower = sum(map(str.islower, tokens))
    if not (lower >= 3 or lower >= 1 and len(tokens) <= 7) or lower < 0.15 * len(tokens):
        return 0
    odd = len(ODD.findall(piece))
    if odd > 0.04 * n:  # names of functions and columns have low lines inside
        odd = sum(len(ODD.findall(t)) for t in tokens if not NAME.search(t))
    return n if odd <= 0.04 * n else 0


def _single(text: str) -> str:
    """A text with single blanks, also at its ends if it has white space there."""
    body = " ".join(text.split())
    if not body:
        return " " if text else ""
    return " " * text[0].isspace() + body + " " * text[-1].isspace()


def _open(text: str) -> str | None:
    """A piece that is still open, with single blanks; None if it is too long for a sentence whatever follows."""
    text = _single(text)
    return text if len(text.strip()) <= LONGEST else None


def _joined(a: str | None, b: str | None) -> str | None:
    """Two stretches of a piece as one."""
    return None if a is None or b is None else _open(a + b)


def _close(c: dict, piece: str | None, lexicon: Lexicon) -> None:
    """Count a finished piece, if it is a readable sentence."""
    if not piece:
        return
    text = " ".join(piece.split())
    if not text or len(text) > LONGEST:
        return
    left = LEFT_OVER.match(text)
    text = text[left.end() :] if left else text
    text = text.strip().rstrip(CLOSERS)
    n = readable(text, lexicon) if text and text[-1] in ENDS else 0
    if n:
        c["sentences"] += 1
        c["prose_chars"] += n


def _without_tags(window: str, a: int, b: int) -> tuple[str, str, int]:
    """The stretch a to b of a window without tags, what follows it, and how many characters (no white space) of the stretch lie in tags."""
    if "<" not in window:
        return window[a:b], window[b : b + CONTEXT], 0
    core, after, at, inside = [], [], 0, 0

    def keep(low: int, high: int) -> None:
        core.append(window[max(low, a) : min(high, b)])
        after.append(window[max(low, b) : high])

    for m in TAG.finditer(window):
        s, e = m.span()
        keep(at, s)
        if s >= a:
            (core if s < b else after).append(BREAK if m[1] else GAP)
        inside += len("".join(window[max(s, a) : min(e, b)].split()))
        at = e
    keep(at, len(window))
    return "".join(core), "".join(after), inside


def _line(s: str) -> tuple[str, bool]:
    """The last character of a line that is not white space, and whether there is one."""
    s = s.rstrip()
    return (s[-1], True) if s else ("", False)


class Part:
    """The counts of a stretch of text (a to b of a window) and the state of its edges.

    head: the piece up to the first boundary, last: the one after the last boundary; without a boundary the whole stretch is
    the head and `last` is None. Each is a tuple whose first entry is the text, or None if it is too long for a sentence.
    """

    __slots__ = STATE

    def __init__(self, window: str, a: int, b: int, lexicon: Lexicon):
        c = dict.fromkeys(COUNTS, 0)
        text = window[a:b]
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        kinds = np.bincount(_classes()[codes], minlength=5)
        c["chars"], c["letters"], c["digits"], c["symbols"], c["cjk"] = int(kinds[1:].sum()), int(kinds[1] + kinds[4]), int(kinds[2]), int(kinds[3]), int(kinds[4])
        # The words that begin in the stretch; one that goes on beyond it is seen whole if it is not too long to be common.
        spaced = CJK.sub(" ", window) if not window.isascii() else window
        low, high = a, b
        if a and not spaced[a - 1].isspace():
            low = RUN.match(spaced, a, b).end()
        if low < b and not spaced[b - 1].isspace():
            high = RUN.match(spaced, b, min(len(spaced), b + LONGEST_WORD + 1)).end()
        own = spaced[low:high] if low < b else ""
        c["words"], c["word_chars"] = len(own.split()) + c["cjk"], c["chars"]
        latin = lexicon.latin
        c["common"] = sum(w in latin for w in [t.strip(PUNCTUATION) for t in own.lower().split() if len(t) <= LONGEST_WORD])
        if lexicon.starts and not window.isascii():
            reach = window[a : b + LONGEST_WORD]
            c["common"] += sum(m.start() < b - a for m in lexicon.starts.finditer(reach))
        lines = text.split("\n")
        stripped = [s for s in (x.rstrip() for x in lines) if s]
        c["lines"], c["punct_lines"] = len(stripped), sum(s[-1] in LINE_ENDS for s in stripped)
        self.broken = len(lines) > 1
        self.line_l, self.line_r = _line(lines[0]), _line(lines[-1])
        plain, after, c["tag_chars"] = _without_tags(window, a, b)
        end, at, self.head = len(plain), 0, None
        first = True
        for m in BOUND.finditer(plain + after[:CONTEXT] if after else plain):
            if m.start() >= end:
                break
            if first:
                self.head, first = plain[: m.end()], False
            else:
                _close(c, plain[at : m.end()], lexicon)
            at = m.end()
        self.head, self.last = ((_open(plain),), None) if first else ((_open(self.head),), (_open(plain[at:]),))
        self.counts = c


def merge(a: Part, b: Part, lexicon: Lexicon) -> Part:
    """Two neighbouring stretches as one."""
    out = object.__new__(Part)
    c = {k: a.counts[k] + b.counts[k] for k in COUNTS}
    # The line across the cut was counted as two.
    (ae, a_some), (be, b_some) = a.line_r, b.line_l
    if a_some and b_some:
        c["lines"] -= 1
        c["punct_lines"] -= ae in LINE_ENDS
    joint = (be, True) if b_some else (ae, a_some)
    out.line_l = a.line_l if a.broken else joint
    out.line_r = b.line_r if b.broken else joint
    out.broken = a.broken or b.broken
    # The piece across the cut.
    across = _joined((a.head if a.last is None else a.last)[0], b.head[0])
    if a.last is None:
        out.head, out.last = (across,), b.last
    elif b.last is None:
        out.head, out.last = a.head, (across,)
    else:
        _close(c, across, lexicon)
        out.head, out.last = a.head, b.last
    out.counts = c
    return out


def finish(part: Part, lexicon: Lexicon) -> dict:
    """The counts of a text whose edges are its ends."""
    for piece in (part.head, part.last):
        if piece is not None:
            _close(part.counts, piece[0], lexicon)
    return part.counts


def count_text(text: str, lexicon: Lexicon) -> dict:
    """The counts of a whole text at once."""
    return finish(Part(text, 0, len(text), lexicon), lexicon)


def merged(parts: Sequence[Part], lexicon: Lexicon) -> Part:
    """Parts in order as one, neighbour by neighbour."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [merge(parts[i], parts[i + 1], lexicon) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def count_chunks(text: str, cuts: Sequence[int], lexicon: Lexicon) -> dict:
    """The counts of a text cut at the given positions (ascending, within the text)."""
    edges = [0, *cuts, len(text)]
    parts = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        start = max(0, low - CONTEXT)
        parts.append(Part(text[start : high + CONTEXT], low - start, high - start, lexicon))
    return finish(merged(parts, lexicon), lexicon)


def _pack(part: Part) -> bytes:
    return pickle.dumps([getattr(part, k) for k in STATE])


def _unpack(data: bytes) -> Part:
    part = object.__new__(Part)
    for k, v in zip(STATE, pickle.loads(data), strict=True):
        setattr(part, k, v)
    return part


def _cut_text(text: Column, chunk: int) -> Column:
    """An array of a text's chunks, each with its context: lead (characters of context before it), size, window.

    Two steps, so that cutting a huge text does not walk it from the start for every chunk.
    """
    big, n = chunk * 64, F.length(text)
    last = lambda rest, size: F.ceil(rest / size).cast("int") - 1

    def large(i: Column) -> Column:
        start = i * big
        before = F.least(F.lit(CONTEXT), start)
        stretch = F.substring(text, start - before + 1, before + big + CONTEXT)
        size = F.least(F.lit(big), n - start)

        def small(j: Column) -> Column:
            at = before + j * chunk
            lead = F.least(F.lit(CONTEXT), at)
            own = F.least(F.lit(chunk), size - j * chunk)
            return F.struct(lead.cast("int").alias("lead"), own.cast("int").alias("size"), F.substring(stretch, at - lead + 1, lead + own + CONTEXT).alias("window"))

        return F.transform(F.sequence(F.lit(0), last(size, chunk)), small)

    return F.flatten(F.transform(F.sequence(F.lit(0), last(n, big)), large))


def text_statistics(docs: DataFrame, *, id: str, text: str, common_words: Sequence[str], rules: ProseRules | None = None, chunk: int = CHUNK, fan: int = 32) -> DataFrame:
    """Counts, ratios and the prose rules per document: one row for every row of `docs`, with the column `id`.

    common_words: the lexicon (a word list of fixed size, sent along with the code). chunk: characters of a chunk, which changes no
    result; fan: chunks merged at once, in as many rounds as the longest possible text needs. NULL, empty and blank texts have
    counts of 0, NULL ratios and no verdict (`is_prose` NULL). Rows that repeat an id each get their row unless
    their texts are cut, in which case equal ids must have equal texts. An empty table gives no rows.
    """
    lexicon_words = sorted({w for w in common_words if w})
    key = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    one = F.length("text").isNull() | (F.length("text") <= chunk)
    few = key.where(one).select("id", F.lit(0).alias("at"), F.lit(0).alias("lead"), F.length("text").alias("size"), F.col("text").alias("window"))
    rows = key.where(~one).select("id", F.posexplode(_cut_text(F.col("text"), chunk)).alias("at", "p")).select("id", "at", "p.lead", "p.size", "p.window")
    id_field = T.StructField("id", docs.schema[id].dataType)
    counts = [T.StructField(k, T.LongType()) for k in COUNTS]
    schema = T.StructType([id_field, T.StructField("at", T.IntegerType()), *counts, T.StructField("state", T.BinaryType())])

    def work(whole: bool):
        def of(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            lexicon = Lexicon(lexicon_words)
            for batch in batches:
                windows = zip(batch.column("window").to_pylist(), batch.column("lead").to_pylist(), batch.column("size").to_pylist(), strict=True)
                parts = [Part(t or "", low, low + (n or 0), lexicon) for t, low, n in windows]
                counted = [finish(p, lexicon) if whole else p.counts for p in parts]
                arrays = [pa.array([c[k] for c in counted], pa.int64()) for k in COUNTS]
                states = pa.array([None if whole else _pack(p) for p in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at"), *arrays, states], names=schema.names)

        return of

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        lexicon = Lexicon(lexicon_words)
        pdf = pdf.drop_duplicates("at").sort_values("at")
        part = merged([_unpack(s) for s in pdf["state"]], lexicon)
        out = pdf.iloc[:1].copy()
        out["at"] //= fan
        if int(pdf["rounds"].iloc[0]) == 1:
            final = finish(part, lexicon)
            for k in COUNTS:
                out[k] = final[k]
        out["state"] = [_pack(part)]
        return out[schema.names]

    single, many = few.mapInArrow(work(True), schema), rows.mapInArrow(work(False), schema)
    rounds, reach = 1, fan
    while reach * chunk < 2**31:
        rounds, reach = rounds + 1, reach * fan
    for left in range(rounds, 0, -1):
        many = many.withColumn("rounds", F.lit(left)).groupBy("id", F.floor(F.col("at") / fan).alias("block")).applyInPandas(join, schema)
    counted = single.unionAll(many).drop("state", "at")
    return _ratios(counted, id, rules or ProseRules())


@dataclass(frozen=True)
class ProseRules:
    """What running sentences keep to; a document is prose if it breaks no rule. Shares of Chinese decide which bounds hold.

    prose_share: least share of readable sentences. symbols: greatest share of symbols among all characters.
    word_length: bounds of the mean word length, for texts with less than `chinese` Chinese characters. common: least share of
    common words, for documents of at least `enough` words. ends: least share of lines that end in punctuation, where lines
    are not wrapped (fewer than `wrapped` words a line).
    """

    prose_share: float = 0.5
    symbols: float = 0.3
    word_length: tuple[float, float] = (2.5, 12.0)
    chinese: float = 0.1
    common: float = 0.01
    enough: int = 40
    ends: float = 0.1
    wrapped: float = 6.0


def _ratios(counted: DataFrame, id: str, rules: ProseRules) -> DataFrame:
    share_of = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    ratio = lambda a, b: F.round(share_of(a, b), 6)
    visible = F.col("chars") - F.col("tag_chars")
    share = F.round(F.try_divide(F.col("prose_chars").cast("double"), visible), 6)
    length, latin = share_of("word_chars", "words"), share_of("cjk", "chars") < rules.chinese
    broken = {
        "sentences": F.coalesce(share, F.lit(0.0)) <= rules.prose_share,
        "symbols": share_of("symbols", "chars") > rules.symbols,
        "word length": latin & ~length.between(*rules.word_length),
        "common words": (F.col("words") >= rules.enough) & (share_of("common", "words") < rules.common),
        "line ends": (share_of("words", "lines") < rules.wrapped) & (share_of("punct_lines", "lines") < rules.ends),
    }
    said = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in broken.items()]), lambda x: x.isNotNull())
    return counted.select(
        F.col("id").alias(id), F.col("words").alias("word_count"), ratio("word_chars", "words").alias("mean_word_length"), ratio("symbols", "chars").alias("symbol_ratio"),
        ratio("digits", "chars").alias("digit_ratio"), ratio("punct_lines", "lines").alias("punct_line_share"), ratio("common", "words").alias("common_word_share"),
        F.col("sentences").alias("sentence_count"), share.alias("prose_share"), F.when(F.col("chars") > 0, F.array_join(said, ", ")).alias("broken_rules"),
        F.when(F.col("chars") > 0, F.size(said) == 0).alias("is_prose"),
    )

"""Splitting oversized items at natural boundaries.

A text above the limit is split by a hierarchy of separators: section, paragraph, sentence, word, then character, each
level only inside what the level above leaves too long. The parts are packed greedily into pieces up to the limit, and
each piece after the first starts with the end of the one before, from a word boundary on where there is one.

A transcript has no bound. Its text is read in sections, side by side, for the places where it may be cut; one pass over
these places, which are numbers, packs them as if the text were one; and the sections are cut side by side again.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.turns import locator_number
from millrace.plans.session import written

LIMIT, OVERLAP = 12_000, 1_200
#: Lines of a transcript that are read together.
LINES_PER_SECTION = 256
_WHITE = re.compile(r"\s+")
_LEAD = re.compile(r"[ \t]*(?:\n[ \t]*)*")
_HEADING = re.compile(r"#{1,6} ")

_LEVELS = [
    re.compile(r"\f|\n[ \t]*(?:\n[ \t]*)+|\n(?=#{1,6} )"),
    re.compile(r"\n+"),
    re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]*_]*\s+"),
    re.compile(r"\s+"),
]


def _parts(text: str, start: int, end: int, longest: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``longest`` characters; a separator stays with what it ends."""
    if end - start <= longest:
        yield start, end
        return
    if level == len(_LEVELS):
        for s in range(start, end, longest):
            yield s, min(s + longest, end)
        return
    at = start
    for m in _LEVELS[level].finditer(text, start, end):
        if m.end() > at:
            yield from _parts(text, at, m.end(), longest, level + 1)
            at = m.end()
    if at < end:
        yield from _parts(text, at, end, longest, level + 1)


def split_ranges(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces (start, end, fresh) of a text in code points: text[start:end], of which text[fresh:end] is new.

    No piece is longer than ``limit``; the new parts make up the text without gap or overlap. Null has no piece, a text
    up to the limit, the empty one too, has one.
    """
    if text is None:
        return []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    pieces: list[tuple[int, int, int]] = []
    start = fresh = end = 0
    for s, e in _parts(text, 0, len(text), limit - overlap):
        if e - start > limit:
            pieces.append((start, end, fresh))
            fresh = end
            start = max(end - overlap, pieces[-1][2])
            if start and not text[start - 1].isspace():
                gap = re.compile(r"\s+").search(text, start, end)
                # Without a word boundary in reach the overlap starts at a character.
                start = gap.end() if gap and gap.end() < end else start
        end = e
    pieces.append((start, end, fresh))
    return pieces


def pieces_column(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """ARRAY<STRUCT<start, end, fresh>> of a text. Only texts above the limit leave the JVM."""
    made = F.udf(lambda t: split_ranges(t, limit, overlap), "array<struct<start:int,end:int,fresh:int>>", useArrow=True)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit(0).alias("fresh")))
    long = F.length(text) > limit
    return F.when(text.isNull(), F.expr("cast(array() as array<struct<start:int,end:int,fresh:int>>)")).when(long, made(F.when(long, text))).otherwise(whole)


def split_items(items: DataFrame, keys: list[str], text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of each item: (*keys, piece, n_pieces, start, end, fresh[, piece_text]); pieces count from 0.

    Only the keys are kept of an item's columns. A null text has no piece. Repeated rows are items of their own.
    Nothing is shuffled. ``start``, ``end`` and ``fresh`` are as in ``split_ranges``.
    """
    cut = items.select(*keys, F.col(text_col).alias("_text"), pieces_column(F.col(text_col), limit, overlap).alias("_pieces"))
    out = cut.select(*keys, *(["_text"] if with_text else []), F.size("_pieces").alias("n_pieces"), F.posexplode("_pieces").alias("piece", "_p"))
    columns = [*keys, "piece", "n_pieces", "_p.start", "_p.end", "_p.fresh"]
    if with_text:
        columns.append(F.substring(F.col("_text"), F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start")).alias("piece_text"))
    return out.select(*columns)


def transcript_sections(segments: DataFrame) -> DataFrame:
    """Full transcripts by sections: (entry_id, section STRUCT<kind, no>, text).

    Of rows with one entry_id and locator number the smallest segment_id counts; null texts are empty; lines are joined
    by one newline in order. Rows without a locator number come after the others by segment_id. A section has at most
    ``LINES_PER_SECTION`` lines, so that an entry of any number of rows is spread over tasks; sections of one entry are
    joined by one more newline.
    """
    number = locator_number(F.col("locator"))
    place = F.struct(F.when(number.isNull(), 1).otherwise(0).alias("kind"), F.coalesce(number, F.col("segment_id")).cast("long").alias("no"))
    first = segments.select("entry_id", place.alias("place"), F.struct("segment_id", "text").alias("row")).groupBy("entry_id", "place").agg(F.min("row").alias("row"))
    section = F.struct(F.col("place.kind").alias("kind"), F.floor(F.col("place.no") / LINES_PER_SECTION).alias("no"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("row.text", F.lit("")).alias("text")))), lambda x: x["text"])
    return first.withColumn("section", section).groupBy("entry_id", "section").agg(F.array_join(lines, "\n").alias("text"))


def _overlap_start(text: str, lower: int, end: int) -> int:
    """Where the overlap before ``end`` starts that may start at ``lower`` at the earliest; lower > 0."""
    if text[lower - 1].isspace():
        return lower
    gap = _WHITE.search(text, lower, end)
    return gap.end() if gap and gap.end() < end else lower


_PLACES = "size int, ends array<int>, levels array<int>, backs array<int>, onward array<int>, front int, last array<int>, last_backs array<int>, last_onward array<int>, lead int, lead_lines boolean, heading boolean, head string, tail string"


def cutting_places(text: str, longest: int, overlap: int) -> tuple:
    """Where a section, with the newline behind it, may be cut.

    Ends of parts by level: 0 behind a separator of sections, 1 behind a newline, 2 inside a line that is too long; for
    each how far before it the overlap starts (0 where that lies before the section), and for one that no white space
    stands before, how far behind it the next word starts (else 0). Then what the section's edges need: how many of these
    places come before its last line, and the places in that line if the section is the last and has no newline behind
    it; its leading blank lines, whether it starts with a heading, and its first and last characters.
    """
    text += "\n"
    zero = {m.end() for m in _LEVELS[0].finditer(text)}
    ends: list[int] = []
    levels: list[int] = []
    at = front = 0
    for e in sorted(zero | {m.end() for m in _LEVELS[1].finditer(text)}):
        front, start = len(ends), at
        if e - at > longest:
            for _, inner in _parts(text, at, e, longest, 2):
                if inner < e:
                    ends.append(inner)
                    levels.append(2)
        ends.append(e)
        levels.append(0 if e in zero else 1)
        at = e
    last = [e for _, e in _parts(text, start, len(text) - 1, longest, 2) if e > start]
    back = lambda e: e - _overlap_start(text, e - overlap, e) if e > overlap else 0
    onward = lambda e: 0 if text[e - 1].isspace() else _WHITE.search(text, e).end() - e
    lead = _LEAD.match(text).end()
    return len(text), ends, levels, list(map(back, ends)), list(map(onward, ends)), front, last, list(map(back, last)), list(map(onward, last)), lead, "\n" in text[:lead], bool(_HEADING.match(text)), text[: max(overlap, lead) + 1], text[-overlap - 1 :]


def _reader(longest: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        types = (pa.int32(), ints, ints, ints, ints, pa.int32(), ints, ints, ints, pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
        names = [x.split(" ")[0] for x in _PLACES.split(", ")]
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                columns = list(zip(*(cutting_places(t, longest, overlap) for t in batch.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays([batch.column("entry_id"), batch.column("section")] + [pa.array(c, t) for c, t in zip(columns, types)], names=["entry_id", "section", *names])

    return run


class _Packer:
    """Greedy packing of one transcript, section by section: ``split_ranges`` on what it knows of the text."""

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap, self.longest = limit, overlap, limit - overlap
        self.size = self.begin = self.fresh = self.end = self.before = 0
        self.context = ""  # the last characters before the section
        self.parts: list[tuple[int, int, int]] = []  # lines of the open range: end, back, onward
        self.opened, self.broken = 0, False
        self.last: tuple[int, int, int] = (0, 0, 0)  # of the part that ended last
        self.line: list[tuple[int, int, int, int]] = []  # the last line of the section before: end, level, back, onward
        self.dropped: tuple[int, int, int] | None = None
        self.final: list[tuple[int, int, int]] = []  # the same line if nothing comes behind it
        self.fresh_onward = self.before_onward = 0
        self.done: list[tuple[int, int, int]] = []

    def _close(self) -> None:
        self.done.append((self.begin, self.end, self.fresh))
        self.before, self.before_onward = self.fresh, self.fresh_onward
        self.fresh, self.fresh_onward = self.end, self.last[2]
        if self.end - self.overlap > self.before:
            self.begin = self.end - self.last[1]
        else:
            self.begin = self.before
            if self.before and self.before_onward and self.before + self.before_onward < self.end:
                self.begin = self.before + self.before_onward

    def _part(self, part: tuple[int, int, int]) -> None:
        if part[0] - self.begin > self.limit:
            self._close()
        self.end, self.last = part[0], part

    def _place(self, end: int, level: int, back: int, onward: int) -> None:
        """The next place where the text may be cut."""
        self.parts.append((end, back, onward))
        if not self.broken and end - self.opened > self.longest:
            self.broken = True  # a range that is too long is taken line by line
        if self.broken:
            for part in self.parts:
                self._part(part)
            self.parts.clear()
        if level == 0:
            self._end_range(end)

    def _end_range(self, end: int) -> None:
        if self.parts:
            self._part(self.parts[-1])
            self.parts.clear()
        self.opened, self.broken = end, False

    def section(self, s: dict) -> None:
        offset, near = self.size, self.context + s["head"]
        shift = len(self.context) - offset

        def back_of(end: int) -> int:
            lower = end - self.overlap
            return 0 if lower <= 0 else end + shift - _overlap_start(near, lower + shift, end + shift)

        # White space that the section before ended with goes on.
        white = len(s["head"]) - len(s["head"].lstrip())
        further = lambda end, onward: onward + white if onward and end + onward == offset else onward
        if white:
            self.parts = [(e, b, further(e, o)) for e, b, o in self.parts]
            self.line = [(e, level, b, further(e, o)) for e, level, b, o in self.line]
            self.last = (*self.last[:2], further(self.last[0], self.last[2]))
            self.fresh_onward, self.before_onward = further(self.fresh, self.fresh_onward), further(self.before, self.before_onward)
        extra = None  # where a separator ends that began in the section before
        if self.line:
            for place in self.line[:-1]:
                self._place(*place)
            end, level, back, onward = self.line[-1]
            joins = s["lead"] > 0 and (s["lead_lines"] or level == 0)
            if joins:
                level, extra = 1, offset + s["lead"]
            elif s["heading"]:
                level = 0
            # A run of newlines over the edge ends behind it, unless the line before would get too long by it.
            self.dropped = (end, back, onward)
            run = len(s["head"]) - len(s["head"].lstrip("\n"))
            if not (run and end - (self.parts[-1][0] if self.parts else self.last[0]) + run <= self.longest):
                self._place(end, level, back, onward)
        places = [(offset + e, level, back if e > self.overlap else back_of(offset + e), onward) for e, level, back, onward in zip(s["ends"], s["levels"], s["backs"], s["onward"])]
        if extra is not None:
            at = next((i for i, x in enumerate(places) if x[0] >= extra), len(places))
            if at < len(places) and places[at][0] == extra:
                places[at] = (extra, 0, *places[at][2:])
                front = s["front"]
            else:
                places.insert(at, (extra, 0, back_of(extra), 0))
                front = s["front"] + (at <= s["front"])
        else:
            front = s["front"]
        for place in places[:front]:
            self._place(*place)
        self.line = places[front:]
        self.final = [(offset + e, back if e > self.overlap else back_of(offset + e), onward) for e, back, onward in zip(s["last"], s["last_backs"], s["last_onward"])]
        self.size = offset + s["size"]
        self.context = (self.context + s["tail"] if s["size"] <= self.overlap else s["tail"])[-self.overlap - 1 :]

    def finish(self) -> None:
        """The newline behind the last section isn't there."""
        size = self.size - 1
        placed = self.parts[-1][0] if self.parts else self.last[0]
        # Of an empty last line only a newline behind the line before is left.
        for end, back, onward in self.final or ([self.dropped] if self.dropped and placed < size else []):
            self._place(end, 0 if end == size else 2, back, onward)
        self._end_range(size)
        if size <= self.limit:
            self.done = [(0, size, 0)]
        else:
            self.done.append((self.begin, self.end, self.fresh))


def _packing(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, packer, recent, piece, first = None, None, deque(), 0, True
        rows: list[tuple] = []

        def give() -> None:
            """What the finished pieces take from each section; sections that no later piece can touch are forgotten."""
            nonlocal piece
            for begin, end, fresh in packer.done:
                while recent and recent[0][1] + recent[0][2] <= begin and len(recent) > 1:
                    recent.popleft()
                touched = [x for x in recent if x[1] < end and x[1] + x[2] > begin] or list(recent)[-1:]
                for k, (section, offset, size) in enumerate(touched):
                    rows.append((entry, section, piece, k, len(touched), max(begin - offset, 0), min(end - offset, size), begin, end, fresh))
                piece += 1
            packer.done = []

        def batch_of() -> pa.RecordBatch:
            nonlocal rows
            columns, rows = list(zip(*rows)), []
            names = ["entry_id", "section", "piece", "part", "n_parts", "from", "to", "start", "end", "fresh"]
            types = [pa.string(), pa.struct([("kind", pa.int32()), ("no", pa.int64())]), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for s in (r for k in range(0, batch.num_rows, 16) for r in batch.slice(k, 16).to_pylist()):
                if first or s["entry_id"] != entry:
                    if not first:
                        packer.finish()
                        give()
                    entry, packer, piece, first = s["entry_id"], _Packer(limit, overlap), 0, False
                    recent.clear()
                recent.append((s["section"], packer.size, s["size"]))
                packer.section(s)
                give()
                if len(rows) > 5_000:
                    yield batch_of()
        if not first:
            packer.finish()
            give()
        if rows:
            yield batch_of()

    return run


def _packed(sections: DataFrame, limit: int, overlap: int) -> DataFrame:
    """What each piece takes from each section: (entry_id, section, piece, part, n_parts, from, to, start, end, fresh)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    section = "section struct<kind:int,no:bigint>"
    places = sections.select("entry_id", "section", "text").mapInArrow(_reader(limit - overlap, overlap), f"entry_id string, {section}, {_PLACES}")
    ordered = places.repartition("entry_id").sortWithinPartitions("entry_id", "section")
    return ordered.mapInArrow(_packing(limit, overlap), f"entry_id string, {section}, piece long, part int, n_parts int, `from` int, `to` int, start long, end long, fresh long")


def transcript_lengths(segments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(entry_id, n_chars, n_pieces): characters of each full transcript and the pieces it is cut into."""
    pieces = _packed(transcript_sections(segments), limit, overlap).filter("part = 0")
    return pieces.groupBy("entry_id").agg(F.sum(F.col("end") - F.col("fresh")).alias("n_chars"), F.count(F.lit(1)).alias("n_pieces"))


def transcript_pieces(segments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of each entry's full transcript: (entry_id, piece, start, end, fresh, piece_text), as ``split_ranges`` cuts
    the transcript as one text, whatever its length; only a line that the blank lines behind it alone make too long for
    a part may be cut otherwise at a section's edge. A null entry_id is a transcript of its own."""
    sections = written(transcript_sections(segments))
    parts = written(_packed(sections, limit, overlap))
    joined = parts.join(sections.withColumnsRenamed({"entry_id": "e", "section": "s"}), F.col("entry_id").eqNullSafe(F.col("e")) & (F.col("section") == F.col("s")))
    # Sections stand with the newline behind them, of which the last piece has none.
    text = F.substring(F.concat("text", F.lit("\n")), F.col("from") + 1, F.col("to") - F.col("from"))
    cut = joined.select("entry_id", "piece", "part", "n_parts", "start", "end", "fresh", text.alias("text"))
    keys = ["entry_id", "piece", "start", "end", "fresh"]
    whole = cut.filter("n_parts = 1").select(*keys, F.col("text").alias("piece_text"))
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    return whole.unionAll(cut.filter("n_parts > 1").groupBy(*keys).agg(put.alias("piece_text")))


def too_small_counts(results: DataFrame, lengths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Results whose recorded chunk_count can't hold their entry's transcript: ``results`` plus n_chars, n_pieces.

    A null chunk_count is no claim; an entry without a transcript isn't judged.
    """
    return results.filter("chunk_count is not null").join(lengths, "entry_id").filter(F.col("n_chars") > F.col("chunk_count").cast("long") * limit)

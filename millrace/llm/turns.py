"""Speech transcripts into clean speaker turns.

Segments are read one by one: labels of the channel's speakers, time marks, sound annotations and hesitation sounds are
taken out of the words. Then one sweep goes over the segments in the order of transcript and locator. It runs on range
partitions, each of which closes the turns inside it; only the few runs at a partition's edges are stitched afterwards,
so a transcript of any size is spread over as many tasks as its rows need.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.confusables import skeleton
from millrace.plans.session import written

UNKNOWN = "unknown"
# Hesitation sounds (stretched ones too, but "err" is a verb) and words that tell a bracketed sound annotation.
_HESITATION = re.compile(r"(?<!\w)(?:u+h*m+|u+h+|e+r(?:rr+)?|h+m+)(?!\w)[,.…]*\s*", re.I)
_SOUNDS = frozenset(
    "applause applauding background breath breathing cheering cheers chuckle chuckles chuckling clapping claps clears closes cough coughing coughs crosstalk cry "
    "door foreign inaudible indistinct instrumental laugh laughing laughs laughter mumbles mumbling music noise opens pause phone rings sigh sighing sighs silence "
    "singing sniffs static throat unintelligible whispers".split()
)
_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_TIME = re.compile(rf"[<\[({{]\s*{_CLOCK}(?:\s*-->\s*{_CLOCK})?\s*[>\])}}]\s*(?:[-–—:]\s+)?|(?m:^)\s*{_CLOCK}(?:\s*-->\s*{_CLOCK})?(?:\s*[-–—]\s+|\s*:\s+|\s+|$)")
_BRACKET = re.compile(r"<v(?:\.[\w.]+)?\s+([^<>]{1,80})>|\[([^\[\]]{1,80})\]|\{([^{}]{1,80})\}|<(/?[^<>]{1,80})>|\(([^()]{1,80})\)|\*([^*\n]{1,60})\*|♪[^♪]*♪|[♪♫]+")
#: Where a label may stand: at the start, on a new line, or after a sentence or an annotation.
_PLAIN = re.compile(r"(?:^|(?<=[.!?…:\"”)\]>}*♪]\s)|(?<=\n)|(?<=\x00))[ \t]*(?:>>+[ \t]*|[-–—][ \t]+)?([^\W_](?:[\w.'’#-]|[ \t](?=[\w#])){0,50}?)[ \t]*(:|[ \t][-–—])(?=\s|$|\x00)")
_OPENERS = frozenset(".!?…:\"”)]>}*♪\n\x00")
_SENTENCE = re.compile(r"[.!?…][\"”)\]]*\s+(?=\S)")
_ARROWS = re.compile(r">>+\s*")
_WORD = re.compile(r"[^\W_]+")


def _near(a: str, b: str, most: int = 1) -> bool:
    """Whether two strings differ by at most one insertion, deletion, replacement or swap of neighbours (most = 1), or
    within ``most`` edits."""
    if abs(len(a) - len(b)) > most:
        return False
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return False
        rows.append(row)
    return rows[-1][-1] <= most


class Roster:
    """The speakers of one channel, found by label however it is written."""

    def __init__(self, members: list[dict]):
        self.exact: dict[str, set[str]] = {}
        self.full: list[tuple[str, str]] = []
        self.first: list[tuple[str, str]] = []
        self.seen: dict[str, str | None] = {}
        for m in members:
            name = self.plain(m.get("display_name") or "")
            parts = name.split()
            forms = {name, *(parts[:1] + parts[-1:])}
            if len(parts) > 1:
                forms |= {" ".join(reversed(parts)), "".join(p[0] for p in parts), " ".join(p[0] for p in parts), f"{parts[0]} {parts[-1][0]}", f"{parts[0][0]} {parts[-1]}"}
                self.full.append((name, m["speaker_id"]))
            if parts:
                self.first.append((parts[0], m["speaker_id"]))
            if m.get("role"):
                forms.add(self.plain(m["role"]))
            if m.get("seat") is not None:
                forms |= {f"{word}{gap}{m['seat']}" for word in ("speaker", "spk", "spkr", "s") for gap in ("", " ")}
            for form in forms - {""}:
                self.exact.setdefault(form, set()).add(m["speaker_id"])
        for m in members:  # a whole name or first name is stronger than a surname or initials that another shares
            for form in (self.plain(m.get("display_name") or ""), self.plain(m.get("display_name") or "").split(" ")[0]):
                if form and sum(form == f for f, _ in self.first) <= 1:
                    self.exact[form] = {m["speaker_id"]}

    @staticmethod
    def plain(label: str) -> str:
        words = re.findall(r"[^\W\d_]+|\d+", unicodedata.normalize("NFC", label).casefold())
        return " ".join(w.lstrip("0") or "0" if w.isdigit() else w for w in words)

    def find(self, label: str) -> str | None:
        if label not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[label] = self._find(self.plain(label))
        return self.seen[label]

    def _find(self, name: str) -> str | None:
        if not name or len(name) > 80:
            return None
        hit = self.exact.get(name)
        if hit is None and " " in name:  # "co-host", "Speaker4"
            hit = self.exact.get(name.replace(" ", ""))
        if hit is not None:
            return next(iter(hit)) if len(hit) == 1 else None
        if " " in name and len(name) >= 7:
            for most in (1, 2):
                near = {who for full, who in self.full if _near(name, full, most)}
                if near:
                    return near.pop() if len(near) == 1 else None
        elif len(name) >= 5 and " " not in name:
            near = {who for first, who in self.first if len(first) >= 5 and _near(name, first)}
            return near.pop() if len(near) == 1 else None
        return None


@lru_cache(4096)
def _roster(members: str | None) -> Roster:
    return Roster(json.loads(members) if members else [])


def _stands_alone(t: str, start: int, end: int, inner: str) -> bool:
    """Whether round brackets or asterisks hold no words of the sentences around them: up to four lower-case words
    without a mark, between the end of a sentence and the start of another."""
    before, after = t[max(0, start - 8) : start].rstrip(" \t"), t[end : end + 8].lstrip(" \t")
    bare = inner.islower() and len(inner.split()) <= 4 and all(c.isalpha() or c in " '’-" for c in inner)
    return bare and (not before or before[-1] in _OPENERS) and (not after or after[0] in "\n\x00\x01" or after[0].isupper())


def read_segment(text: str | None, roster: Roster) -> list[tuple[str | None, int, str]]:
    """Parts (speaker_id that a label names or None, number of words, clean text) of one segment, in order."""
    if not text:
        return []
    t = text if text.isascii() else unicodedata.normalize("NFC", skeleton(text))
    if ":" in t:
        t = _TIME.sub("\x00", t)
    labels: list[str] = []

    def bracket(m: re.Match) -> str:
        inner = next((g for g in m.groups() if g is not None), "")
        # Round brackets inside a sentence are an aside, not a label.
        opens = m[5] is None or not (before := t[max(0, m.start() - 8) : m.start()].rstrip(" \t")) or before[-1] in _OPENERS
        who = roster.find(inner) if inner and m[6] is None and opens and not any(c in ",;" for c in inner) else None
        if who:
            labels.append(who)
            return f"\x01{len(labels) - 1}\x01\x00"
        if m[5] is not None or m[6] is not None:  # round brackets and asterisks hold words too
            words = inner.casefold().split()
            sound = 0 < len(words) <= 4 and any(w.strip(".!") in _SOUNDS for w in words)
            return "\x00" if sound or _stands_alone(t, m.start(), m.end(), inner) else m[0]
        return "\x00"

    def plain(m: re.Match) -> str:
        who = roster.find(m[1])
        if not who:
            # A short sentence before the label may have been taken for a part of it.
            end = _SENTENCE.search(m[0])
            return m[0] if not end else m[0][: end.end()] + _PLAIN.sub(plain, m[0][end.end() :])
        labels.append(who)
        return f"\x01{len(labels) - 1}\x01"

    if any(c in t for c in "[(<{*♪♫"):
        t = _BRACKET.sub(bracket, t)
    if ":" in t or " -" in t or "–" in t or "—" in t:
        t = _PLAIN.sub(plain, t)
    t = _HESITATION.sub("", _ARROWS.sub("", t))
    pieces = re.split("\x01(\\d+)\x01", t)
    out: list[tuple[str | None, int, str]] = []
    for i in range(0, len(pieces), 2):
        clean = " ".join(pieces[i].replace("\x00", " ").split()).lstrip(",;:-–— ")
        n = n_words(clean)
        if i or n:
            out.append((labels[int(pieces[i - 1])] if i else None, n, clean if n else ""))
    return out


def seconds_of(ts: Column) -> Column:
    """Seconds of a media time 'HH:MM:SS', with or without fraction, or 'MM:SS'; null where there is none."""
    p = F.split(F.regexp_replace(ts, ",", "."), ":")
    number = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, number(1) * 3600 + number(2) * 60 + number(3)).when(F.size(p) == 2, number(1) * 60 + number(2))


def locator_number(locator: Column) -> Column:
    return F.regexp_extract(locator, r"(\d+)\s*$", 1).try_cast("long")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = batch.column("with_text")[0].as_py() if batch.num_rows else False
        members = batch.column("members").dictionary_encode()
        rosters = [_roster(m) for m in members.dictionary.to_pylist()]
        offsets, who, n, text = [0], [], [], []
        for t, i in zip(batch.column("text").to_pylist(), members.indices.to_pylist()):
            for label, k, clean in read_segment(t, rosters[i] if i is not None else _roster(None)):
                who.append(label)
                n.append(k)
                text.append(clean if keep else None)
            offsets.append(len(who))
        parts = pa.StructArray.from_arrays([pa.array(who, pa.string()), pa.array(n, pa.int32()), pa.array(text, pa.string())], names=["who", "n", "text"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("entry_id", "place", "segment_id", "sec")] + [lists], names=["entry_id", "place", "segment_id", "sec", "parts"])


def overlap(before: list[str], after: list[str], least: int = 3) -> int:
    """Length of the longest suffix of ``before`` that is a prefix of ``after``, at least ``least`` words, else 0."""
    pattern = [w.casefold() for w in after]
    stream = [w.casefold() for w in before[-len(after) :]]
    border = [0] * len(pattern)
    k = 0
    for i in range(1, len(pattern)):
        while k and pattern[i] != pattern[k]:
            k = border[k - 1]
        k += pattern[i] == pattern[k]
        border[i] = k
    k = 0
    for i, w in enumerate(stream):
        while k and (k == len(pattern) or w != pattern[k]):
            k = border[k - 1]
        k += w == pattern[k]
    return k if k >= least else 0


def last_words(pieces: list[str], n: int) -> list[str]:
    """The last n words of a text in pieces."""
    found: list[list[str]] = []
    for piece in reversed(pieces):
        found.append(piece.rsplit(" ", n)[-n:])
        n -= len(found[-1])
        if n <= 0:
            break
    return [w for words in reversed(found) for w in words]


def after_captions(pieces: list[str], after: str) -> str:
    """What a caption adds to a text in pieces: nothing of what a rolling caption repeats, however long it is."""
    words = after.split(" ")
    # An overlap holds the first three words, one after the other.
    if len(words) < 3 or " ".join(words[:3]).casefold() not in " ".join(before := last_words(pieces, len(words))).casefold():
        return after
    return " ".join(words[overlap(before, words) :])


def n_words(text: str) -> int:
    return len(_WORD.findall(text))


def join_captions(before: str | None, after: str | None) -> tuple[str | None, int]:
    """Two neighbouring captions as one text, what a rolling caption repeats only once, and the repeated words."""
    if not before or not after:
        return before or after, 0
    rest = after_captions([before], after)
    return (f"{before} {rest}" if rest else before), (0 if rest == after else n_words(after) - n_words(rest))


_RUN = "entry_id string, part int, seq long, who string, first_segment_id long, last_segment_id long, start double, end double, n_words long, text string, edge boolean, label_after string"


def _sweeper(pause: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [x.split(" ")[0] for x in _RUN.split(", ")]
        runs: list[list] = []
        entry = object()
        head, label, last, made = True, None, None, 0

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            columns[9] = [" ".join(t) if t else None for t in columns[9]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)

        def close(tail: bool) -> Iterator[pa.RecordBatch]:
            """The runs of the entry that ends; those that a neighbouring partition may continue are marked."""
            if entry_rows:
                if head or tail:
                    for i in {0, 1, len(runs) - 1} if head else {len(runs) - 1}:
                        if 0 <= i < len(runs):
                            runs[i][10] = True
                    # The label in force at the end, for the partitions after this one.
                    runs.append([entry, part, made, None, None, None, None, None, 0, [], True, label])
                if runs:
                    yield batch_of(runs)

        entry_rows = False
        for batch in batches:
            lists = batch.column("parts")
            at = lists.offsets.to_pylist()
            flat = lists.values
            who, n, text = (flat.field(c).to_pylist() for c in ("who", "n", "text"))
            for row, (e, segment, sec) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("entry_id", "segment_id", "sec")))):
                if not entry_rows or e != entry:
                    if entry_rows:
                        yield from close(False)
                        head = False
                    # Only the partition's first entry can go on from the partition before.
                    entry, runs, label, last, made, entry_rows = e, [], None if head else UNKNOWN, None, 0, True
                for p in range(at[row], at[row + 1]):
                    if who[p]:
                        label = who[p]
                    if not n[p]:
                        continue
                    paused = pause is not None and last is not None and sec is not None and sec - last > pause
                    if runs and runs[-1][3] == label and not paused:
                        r = runs[-1]
                        rest = after_captions(r[9], text[p]) if text[p] else None
                        r[5], r[8] = segment, r[8] + (n[p] if rest == text[p] else n_words(rest))
                        if rest:
                            r[9].append(rest)
                        r[7] = sec if sec is not None else r[7]
                    else:
                        # Without a label yet, the speaker comes from a partition before; the first run with one may go on.
                        edge = label is None or bool(runs) and runs[-1][3] is None
                        runs.append([entry, part, made, label, segment, segment, sec, sec, n[p], [text[p]] if text[p] else [], edge, None])
                        made += 1
                    last = sec if sec is not None else last
                if len(runs) > 5000:  # turns that are surely closed don't wait for the entry's end
                    done, runs[2:-2] = runs[2:-2], []
                    yield batch_of(done)
        if entry_rows:
            yield from close(True)

    return run


_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]


def _stitcher(pause: float | None):
    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        """Runs at the edges of partitions, of one entry and in order: a few for each partition the entry touches, and
        those between pauses before a partition's first label."""
        out: list[dict] = []
        label, before = UNKNOWN, None
        for r in rows.sort_values(["part", "seq"]).to_dict("records"):
            if pd.isna(r["first_segment_id"]):
                label = label if pd.isna(r["label_after"]) else r["label_after"]
                continue
            if pd.isna(r["who"]):
                r["who"] = label
            gap = None if before is None or pd.isna(r["start"]) or pd.isna(before["end"]) else r["start"] - before["end"]
            # Neighbours are the next run of the partition, or the last and the first of two partitions.
            touches = before is not None and (r["part"] == before["part"] and r["seq"] == before["seq"] + 1 or r["part"] != before["part"] and r["seq"] == 0)
            if touches and before["who"] == r["who"] and not (pause is not None and gap is not None and gap > pause):
                joined, repeated = join_captions(before["text"], r["text"])
                before.update(last_segment_id=r["last_segment_id"], n_words=before["n_words"] + r["n_words"] - repeated, text=joined, part=r["part"], seq=r["seq"])
                before["end"] = before["end"] if pd.isna(r["end"]) else r["end"]
            else:
                out.append(r)
                before = r
        return pd.DataFrame(out, columns=rows.columns).astype({"first_segment_id": "int64", "last_segment_id": "int64"}) if out else rows.iloc[:0]

    return stitch


def _ordered(segments: DataFrame, speakers: DataFrame, with_text: bool) -> DataFrame:
    members = speakers.filter("channel is not null").groupBy("channel").agg(F.to_json(F.sort_array(F.collect_set(F.struct("speaker_id", "seat", "role", "display_name")))).alias("members"))
    number = locator_number(F.col("locator"))
    # Without a number the locator orders nothing: such rows follow the others by segment_id, and none repeats another.
    place = F.when(number.isNotNull(), F.struct(F.lit(0).alias("kind"), number.alias("no"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("segment_id").cast("long").alias("no")))
    rows = segments.select("entry_id", F.col("segment_id").cast("long").alias("segment_id"), "channel", "text", place.alias("place"), seconds_of(F.col("ts")).alias("sec"))
    read = rows.join(members, "channel", "left").select("entry_id", "place", "segment_id", "sec", "text", "members", F.lit(with_text).alias("with_text")).mapInArrow(
        _reader, "entry_id string, place struct<kind:int,no:bigint>, segment_id long, sec double, parts array<struct<who:string,n:int,text:string>>"
    )
    first = read.groupBy("entry_id", "place").agg(F.min(F.struct("segment_id", "sec", "parts")).alias("x"))
    return first.select("entry_id", "place", "x.*").repartitionByRange("entry_id", "place").sortWithinPartitions("entry_id", "place")


def speaker_turns(segments: DataFrame, speakers: DataFrame, pause: float | None = None, with_text: bool = True) -> DataFrame:
    """Turns: (entry_id, first_segment_id, last_segment_id, speaker_id, start, end, n_words, text).

    segments: entry_id, segment_id BIGINT unique, channel, text, locator, ts; speakers: speaker_id, channel, seat,
    role, display_name. Of rows with one entry_id and locator number the smallest segment_id counts. A label names a
    member of the channel's speakers in any usual writing, with look-alike letters or a misspelt name; words before
    any have the speaker 'unknown'. ``n_words`` counts the words of the turn, of a rolling caption's repeats none where the
    text is kept. Segments without words (null, empty, annotations, hesitations) neither make nor end
    a turn. ``pause`` ends a turn at a longer silence in seconds too (see ``calibrated_pause``); None: never. Null
    entry_ids are one transcript, unknown channels have no labels. A turn's text is one value, whatever its length.
    """
    # Both parts must come from one and the same partitioning, so it is made once, as a table.
    runs = written(_ordered(segments, speakers, with_text).mapInArrow(_sweeper(pause), _RUN))
    done = runs.filter("not edge")
    stitched = runs.filter("edge").groupBy("entry_id").applyInPandas(_stitcher(pause), _RUN)
    return done.unionAll(stitched).select("entry_id", "first_segment_id", "last_segment_id", F.col("who").alias("speaker_id"), "start", "end", "n_words", "text")


def calibrated_pause(segments: DataFrame, quantile: float = 0.999, factor: float = 2.0, least: float = 8.0) -> float:
    """A silence in seconds that is long for these transcripts: ``factor`` times a high quantile of the steps from one
    time to the next in order of locator. Each range partition gives its own steps, so one a partition is left out."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, last = None, None
        for batch in batches:
            out = []
            for e, sec in zip(batch.column("entry_id").to_pylist(), batch.column("sec").to_pylist()):
                if last is not None and e == entry and sec >= last:
                    out.append(sec - last)
                entry, last = e, sec
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["step"])

    rows = segments.select("entry_id", locator_number(F.col("locator")).alias("no"), seconds_of(F.col("ts")).alias("sec")).filter("sec is not null and no is not null")
    found = rows.repartitionByRange("entry_id", "no").sortWithinPartitions("entry_id", "no").mapInArrow(steps, "step double").agg(F.percentile_approx("step", quantile, 10_000).alias("q")).first()["q"]
    return max(least, factor * (found or 0.0))

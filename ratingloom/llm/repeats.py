"""Removal of long word runs that an earlier document has too.

A suffix is a text from one word on.  A repeat of ``window`` words or more is an inner
node of the suffix tree that lies that deep.  The tree is never built whole:

1. Of every window of words, the least numbered run of eight words is its anchor;
   equal windows have equal anchors.  Only suffixes whose first window has an anchor
   that occurs in several documents go on.  Suffixes that follow each other and have
   the same anchor are one slice of the text.
2. Slices are split by anchor into groups that fit in memory.  Equal slices count
   once, for their smallest document.
3. A group's subtree is its sorted suffixes with the lengths of the prefixes that
   neighbours share.  Every suffix asks for its deepest node that holds a smaller
   document; the node's depth is how far the suffix repeats.  Of suffixes that
   follow each other only those stay that reach beyond the one before: the
   maximal repeats, as document, start and length.

An anchor in very many documents would make one group of them all.  Its suffixes
take longer prefixes, whole windows: parts of their documents are reduced to one
smallest document per window each, the windows of all parts are merged, and those
that several documents have go back to the parts.

Texts that are word for word the same are settled before: the smallest document
stands for all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ratingloom.llm.rows import as_array, buckets_of, tidied
from ratingloom.llm.words import WORD, Runs, fingerprint, grams, mix, word_arrays
from ratingloom.session import stage

ANCHOR_WORDS = 8
#: Suffixes of one slice at most: a slice has fewer than 128 words with windows of 50.
SLICE_SUFFIXES = 64
#: Documents of an anchor beyond which its suffixes take whole windows as prefixes.
HOT_DOCUMENTS = 1024
#: Words of the slices whose subtree is built at once, about; a group may have several subtrees.
TREE_WORDS = 1 << 18
#: Suffixes of one group, about.
GROUP_SUFFIXES = 1 << 18
_REPEATS = "doc_id long, text_hash long, start int, length int"


def anchors_of(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of every window: the least number of its runs of eight words."""
    runs = grams(words, ANCHOR_WORDS)
    width = window - ANCHOR_WORDS + 1
    least, span = runs, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (width - span)], least[width - span :])


def ragged(order: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the items of some lists, in the given order, stand among those of all lists one after another."""
    first = np.cumsum(sizes) - sizes
    taken = sizes[order]
    return np.repeat(first[order] - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))


class Subtree:
    """The sorted suffixes of several slices, with the lengths of the prefixes that neighbours share.

    ``words`` are the slices' words one after another, ``sizes`` their lengths; a suffix
    starts wherever ``window`` words of its slice are left, and ends with the slice.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, window: int) -> None:
        slices = len(sizes)
        _, ids = np.unique(words, return_inverse=True)
        # An end of its own after every slice: no prefix runs from one into the next.
        first = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.full(int(sizes.sum()) + slices, -1, np.int64)
        inside = np.repeat(first, sizes) + np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[inside] = ids
        text[text < 0] = len(words) + np.arange(slices)
        # Ranks of prefixes of 1, 2, 4, ... words, each from two of the ones before.
        self._ranks = [text]
        longest = int(sizes.max(initial=1))
        while 1 << (len(self._ranks) - 1) < longest:
            last, half = self._ranks[-1], 1 << (len(self._ranks) - 1)
            later = np.append(last[half:], np.zeros(min(half, len(last)), np.int64))[: len(last)]
            self._ranks.append(np.unique(last * (2 * len(text) + 1) + later, return_inverse=True)[1])
        counts = np.maximum(sizes - window + 1, 0)
        #: Slice and place in the slice of every suffix, in text order.
        self.slice = np.repeat(np.arange(slices), counts)
        self.place = np.arange(len(self.slice)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = first[self.slice] + self.place
        #: The suffixes in sorted order, and the words each shares with the one before it.
        self.order = np.argsort(self._ranks[-1][at], kind="stable")
        self.shared = self._common(at[self.order])
        self._window = window

    def _common(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        if len(at) > 1:
            left, right, found = at[:-1], at[1:], np.zeros(len(at) - 1, np.int64)
            for level in range(len(self._ranks) - 1, -1, -1):
                same = self._ranks[level][left + found] == self._ranks[level][right + found]
                found += same << level
            out[1:] = found
        return out

    def repeats(self, documents: np.ndarray) -> np.ndarray:
        """For every suffix the depth of its deepest node that holds a document smaller than its own, or 0.

        ``documents`` holds one number a slice.
        """
        depth = np.zeros(len(self.order), np.int64)
        here, own, shared = self.order, documents[self.slice[self.order]], self.shared
        level = self._window
        while len(here):
            # The nodes of this depth: neighbours that share so many words; a suffix alone has none.
            opens = shared < level
            opens[:1] = True
            closes = np.append(opens[1:], True)
            stay = ~(opens & closes)
            here, own, shared, opens = here[stay], own[stay], np.where(opens, 0, shared)[stay], opens[stay]
            if len(here):
                first = np.flatnonzero(opens)
                least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
                depth[here[least < own]] = level
            level += 1
        return depth

    def maximal(self, depth: np.ndarray) -> np.ndarray:
        """The repeating suffixes that reach beyond the one before them in their slice."""
        reach = self.place + depth
        before = np.zeros(len(depth), np.int64)
        before[1:] = np.where(self.slice[1:] == self.slice[:-1], np.where(depth[:-1] > 0, reach[:-1], 0), 0)
        return np.flatnonzero((depth > 0) & (reach > before))


def _profiles(documents: DataFrame, window: int) -> DataFrame:
    """``doc_id, text_hash, print, anchors`` of the texts that hold a window."""

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints, anchors = [], []
            for words in word_arrays(frame["text"], lower=False):
                long = len(words) >= window
                prints.append(fingerprint(words) if long else None)
                anchors.append(np.unique(anchors_of(words, window)).view(np.int64) if long else None)
            out = pd.DataFrame({"doc_id": frame["doc_id"], "text_hash": frame["text_hash"], "print": prints, "anchors": anchors})
            yield out[out["print"].notna()]

    return documents.mapInPandas(tidied(described), "doc_id long, text_hash long, print binary, anchors array<long>")


#: A slice: its anchor, its document and text, its number, its words, and where in the text it begins, once or more.
_SLICES = {"anchors": "<u8", "documents": "<i8", "hashes": "<i8", "prints": "<u8", "sizes": "<i8", "times": "<i8", "words": "<u8", "begins": "<i4"}
#: A suffix with a hot anchor: its document and text, its window's number, its start.
_HOT = {"documents": "<i8", "hashes": "<i8", "prints": "<u8", "starts": "<i4"}


def slices_of(starts: np.ndarray, anchors: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Cut suffixes that follow each other with one anchor into slices; a slice that comes back counts once.

    Returns anchor, number, size and times of every different slice, then the words
    and the beginnings of all of them.
    """
    runs = Runs(words)
    opens = np.append(True, (np.diff(starts) != 1) | (anchors[1:] != anchors[:-1]))[: len(starts)]
    first = np.flatnonzero(opens)
    within = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    first = np.flatnonzero(within % SLICE_SUFFIXES == 0)
    last = np.append(first[1:], len(starts)) - 1
    begins, sizes = starts[first], starts[last] - starts[first] + window
    prints = runs.at(begins, sizes)
    order = np.lexsort((begins, prints))
    new = np.flatnonzero(np.append(True, prints[order][1:] != prints[order][:-1])[: len(order)])
    kept = order[new]
    taken = np.repeat(begins[kept] - (np.cumsum(sizes[kept]) - sizes[kept]), sizes[kept]) + np.arange(int(sizes[kept].sum()))
    times = np.diff(np.append(new, len(order)))
    return anchors[first][kept], prints[kept], sizes[kept], times, words[taken], begins[order].astype(np.int32)


def _suffixes(documents: DataFrame, window: int, buckets: int, parts: int, hot: int) -> DataFrame:
    """``kind, bucket, part`` with blobs: slices (kind 0), and the suffixes of hot anchors (kind 1)."""
    blobs = list(dict.fromkeys([*_SLICES, *_HOT]))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cold: list[tuple] = []
            warm: list[tuple] = []
            size = 0
            rows = zip(frame["doc_id"], frame["text_hash"], frame["anchors"], frame["held"], word_arrays(frame["text"], lower=False))
            for doc_id, text_hash, anchors, counts, words in rows:
                known = np.asarray(anchors).view(np.uint64)
                order = np.argsort(known)
                known, counts = known[order], np.asarray(counts)[order]
                of_window = anchors_of(words, window)
                at = np.minimum(np.searchsorted(known, of_window), len(known) - 1)
                found = known[at] == of_window
                busy = found & (counts[at] > hot)
                starts = np.flatnonzero(found & ~busy)
                if len(starts):
                    anchor, prints, *rest = slices_of(starts, of_window[starts], words, window)
                    n = len(anchor)
                    cold.append((anchor, anchor, np.full(n, doc_id), np.full(n, text_hash), prints, *rest))
                starts = np.flatnonzero(busy)
                if len(starts):
                    n = len(starts)
                    warm.append((of_window[starts], np.full(n, doc_id), np.full(n, text_hash), Runs(words).at(starts, window), starts))
                size += len(words)
                if size >= GROUP_SUFFIXES:
                    yield from packed(cold, warm)
                    cold, warm, size = [], [], 0
            yield from packed(cold, warm)

    def packed(cold: list[tuple], warm: list[tuple]) -> Iterator[pd.DataFrame]:
        for kind, held, names in ((0, cold, _SLICES), (1, warm, _HOT)):
            if not held:
                continue
            anchor, *columns = (np.concatenate(c) for c in zip(*held))
            # Anchors are least numbers: scrambled, they fill the buckets evenly.
            bucket = buckets_of(mix(anchor), buckets)
            # All of a document's suffixes with one anchor stay in one part.
            part = columns[0] % parts if kind else np.zeros(len(bucket), np.int64)
            route = bucket * parts + part
            order = np.argsort(route, kind="stable")
            full, first = np.unique(route[order], return_index=True)
            cuts = np.append(first, len(order))
            out = {"kind": kind, "bucket": (full // parts).astype(np.int32), "part": (full % parts).astype(np.int32)}
            for name in blobs:
                out[name] = None
            for (name, shape), column in zip(names.items(), columns):
                ends = cuts
                lists = {"words": "sizes", "begins": "times"}.get(name)
                if lists:
                    lengths = columns[list(names).index(lists)]
                    column = column[ragged(order, lengths)]
                    ends = np.append(0, np.cumsum(lengths[order]))[cuts]
                else:
                    column = column[order]
                column = column.astype(shape)
                out[name] = [column[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pd.DataFrame(out)

    shape = "kind int, bucket int, part int, " + ", ".join(f"{n} binary" for n in blobs)
    return documents.mapInPandas(tidied(cut), shape)


def _columns(group: pd.DataFrame, names: dict[str, str]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([as_array(b, k) for b in group[n]]) if len(group) else np.zeros(0, k) for n, k in names.items()}


def _rows(documents: np.ndarray, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": documents, "text_hash": hashes, "start": starts.astype(np.int32), "length": lengths.astype(np.int32)})


def repeats_of_slices(held: dict[str, np.ndarray], window: int) -> pd.DataFrame:
    """The maximal repeats of a group of slices: ``doc_id, text_hash, start, length``."""
    kinds, at = np.unique(held["prints"], return_inverse=True)
    smallest = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(smallest, at, held["documents"])
    one = np.zeros(len(kinds), np.int64)
    one[at] = np.arange(len(at))
    sizes = held["sizes"][one]
    # Equal windows have equal anchors, so the slices of some anchors make a subtree of their own.
    by_anchor = np.argsort(held["anchors"][one], kind="stable")
    anchors = held["anchors"][one][by_anchor]
    heads = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])[: len(anchors)])
    before = np.cumsum(sizes[by_anchor]) - sizes[by_anchor]
    _, cuts = np.unique(before[heads] // TREE_WORDS, return_index=True)
    edges = np.append(heads[cuts], len(one))
    kinds_of, places, depths = [], [], []
    for a, b in zip(edges, edges[1:]):
        some = by_anchor[a:b]
        tree = Subtree(held["words"][ragged(one[some], held["sizes"])], sizes[some], window)
        depth = tree.repeats(smallest[some])
        chosen = tree.maximal(depth)
        kinds_of.append(some[tree.slice[chosen]])
        places.append(tree.place[chosen])
        depths.append(depth[chosen])
    found = np.concatenate(kinds_of)
    # Per kind of slice: the whole of it for later documents, its repeats for the smallest one.
    kind = np.concatenate((found, np.arange(len(kinds))))
    place = np.concatenate((*places, np.zeros(len(kinds), np.int64)))
    length = np.concatenate((*depths, sizes))
    whole = np.concatenate((np.zeros(len(found), bool), np.ones(len(kinds), bool)))
    order = np.argsort(kind, kind="stable")
    kind, place, length, whole = kind[order], place[order], length[order], whole[order]
    first, last = np.searchsorted(kind, at), np.searchsorted(kind, at, "right")
    row = np.repeat(np.arange(len(at)), last - first)
    entry = np.repeat(first - np.cumsum(last - first) + (last - first), last - first) + np.arange(len(row))
    later = held["documents"] > smallest[at]
    fits = whole[entry] == later[row]
    row, entry = row[fits], entry[fits]
    # Every beginning of a slice has the slice's repeats.
    times = held["times"]
    begins = held["begins"][ragged(row, times)]
    row, entry = np.repeat(row, times[row]), np.repeat(entry, times[row])
    return _rows(held["documents"][row], held["hashes"][row], begins + place[entry], length[entry])


def _cold_repeats(slices: DataFrame, window: int) -> DataFrame:
    def found(group: pd.DataFrame) -> pd.DataFrame:
        return repeats_of_slices(_columns(group, _SLICES), window)

    return slices.groupBy("bucket").applyInPandas(found, _REPEATS)


def _hot_repeats(suffixes: DataFrame, window: int, buckets: int, parts: int) -> DataFrame:
    """Repeats among suffixes whose anchor is in very many documents."""

    def reduced(group: pd.DataFrame) -> pd.DataFrame:
        held = _columns(group, _HOT)
        order = np.lexsort((held["documents"], held["prints"]))
        prints, documents = held["prints"][order], held["documents"][order]
        first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        last = np.append(first[1:], len(prints)) - 1
        return spread(prints[first], documents[first], documents[last], np.full(len(first), int(group["bucket"].iat[0]), np.int64))

    def spread(prints: np.ndarray, least: np.ndarray, most: np.ndarray, bucket: np.ndarray) -> pd.DataFrame:
        route = buckets_of(prints, buckets)
        order = np.argsort(route, kind="stable")
        full, first = np.unique(route[order], return_index=True)
        ends = np.append(first[1:], len(order))
        columns = {"prints": prints, "least": least, "most": most, "buckets": bucket}
        return pd.DataFrame({"route": full.astype(np.int32)} | {
            n: [c[order][a:b].tobytes() for a, b in zip(first, ends)] for n, c in columns.items()
        })

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        kinds = {"prints": "<u8", "least": "<i8", "most": "<i8", "buckets": "<i8"}
        held = _columns(group, kinds)
        order = np.argsort(held["prints"], kind="stable")
        prints, bucket = held["prints"][order], held["buckets"][order]
        first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        least = np.minimum.reduceat(held["least"][order], first)
        several = np.flatnonzero(np.maximum.reduceat(held["most"][order], first) > least)
        prints, least, bucket = prints[first][several], least[several], bucket[first][several]
        order = np.argsort(bucket, kind="stable")
        full, at = np.unique(bucket[order], return_index=True)
        ends = np.append(at[1:], len(order))
        return pd.DataFrame({
            "bucket": full.astype(np.int32), "prints": [prints[order][a:b].tobytes() for a, b in zip(at, ends)],
            "least": [least[order][a:b].tobytes() for a, b in zip(at, ends)],
        })

    def marked(own: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        held, known = _columns(own, _HOT), _columns(shared, {"prints": "<u8", "least": "<i8"})
        if not len(held["prints"]) or not len(known["prints"]):
            return _rows(*[np.zeros(0, np.int64)] * 4)
        order = np.argsort(known["prints"])
        prints, least = known["prints"][order], known["least"][order]
        at = np.minimum(np.searchsorted(prints, held["prints"]), len(prints) - 1)
        later = np.flatnonzero((prints[at] == held["prints"]) & (least[at] < held["documents"]))
        if not len(later):
            return _rows(*[np.zeros(0, np.int64)] * 4)
        documents, hashes, starts = (held[c][later] for c in ("documents", "hashes", "starts"))
        order = np.lexsort((starts, hashes, documents))
        documents, hashes, starts = documents[order], hashes[order], starts[order]
        # Windows that follow each other are one repeat.
        opens = np.append(True, (np.diff(documents) != 0) | (np.diff(hashes) != 0) | (np.diff(starts) > 1))[: len(starts)]
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(starts)) - 1
        return _rows(documents[first], hashes[first], starts[first], starts[last] - starts[first] + window)

    rows = suffixes.groupBy("bucket", "part").applyInPandas(reduced, "route int, prints binary, least binary, most binary, buckets binary")
    shared = rows.groupBy("route").applyInPandas(merged, "bucket int, prints binary, least binary")
    shared = shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = suffixes.groupBy("bucket", "part")
    return own.cogroup(shared.groupBy("bucket", "part")).applyInPandas(marked, _REPEATS)


def repeated_runs(
    documents: DataFrame, window: int = 50, buckets: int | None = None, hot: int = HOT_DOCUMENTS
) -> DataFrame:
    """``doc_id, text_hash, whole, repeats``: what :func:`remove_repeats` takes out of which text.

    ``repeats`` lists start and length of runs of words that a smaller document has too; they
    overlap where a text repeats several others.  ``whole`` marks copies of whole texts.
    """
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    keyed = keyed.filter("doc_id is not null and text is not null")
    profiles = stage(_profiles(keyed, window), "repeat-profiles")
    smallest = profiles.groupBy("print").agg(F.min("doc_id").alias("smallest"))
    judged = stage(
        profiles.join(smallest, "print").select("doc_id", "text_hash", "anchors", (F.col("doc_id") > F.col("smallest")).alias("copy")),
        "repeat-judged",
    )
    one = judged.filter("not copy").select("doc_id", "text_hash", F.explode("anchors").alias("anchor")).distinct()
    shared = (
        one.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("held"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        .filter("a < b").select("anchor", "held")
    )
    shared = stage(shared, "repeat-anchors")
    size = shared.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("n"), F.coalesce(F.max("held"), F.lit(0)).alias("most")).first()
    groups = buckets or max(16, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                            int(size["n"]) * window // GROUP_SUFFIXES)
    parts = max(1, -(-int(size["most"]) // hot))
    wanted = one.join(shared, "anchor").groupBy("doc_id", "text_hash").agg(
        F.collect_list("anchor").alias("anchors"), F.collect_list("held").alias("held")
    )
    chosen = keyed.join(stage(wanted, "repeat-wanted"), ["doc_id", "text_hash"])
    suffixes = stage(_suffixes(chosen, window, groups, parts, hot), "repeat-suffixes")
    found = _cold_repeats(suffixes.filter("kind = 0"), window)
    if size["most"] > hot:
        found = found.unionByName(_hot_repeats(suffixes.filter("kind = 1"), window, groups, parts))
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "length")).alias("repeats"))
    copies = judged.filter("copy").select("doc_id", "text_hash").distinct()
    none = F.array().cast("array<struct<start:int,length:int>>")
    return found.withColumn("whole", F.lit(False)).unionByName(
        copies.select("doc_id", "text_hash", F.lit(True).alias("whole"), none.alias("repeats"))
    )


def remove_repeats(
    documents: DataFrame, window: int = 50, buckets: int | None = None, hot: int = HOT_DOCUMENTS, spaces: bool = False
) -> DataFrame:
    """``documents`` with ``n_words``, ``n_removed``, ``kept`` and ``kept_sha256``.

    ``kept`` is the text without the words of every window of ``window`` consecutive
    words that also starts in a document with a smaller ``doc_id``; words are joined
    by one space or, with ``spaces``, keep the white space behind them.  Windows are judged on the input.  Null texts and texts shorter
    than a window lose nothing, nor do rows with a null id, which take nothing from
    others either.  Rows with the same id do not take from each other.  An
    empty table gives no rows.  The documents' own columns stay, except ones that
    bear the names of the four.
    """
    kept = documents.drop("n_words", "n_removed", "kept", "kept_sha256")
    lost = stage(repeated_runs(documents, window, buckets, hot), "repeat-runs")
    lost = lost.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("whole").alias("_whole"),
                       F.col("repeats.start").alias("_starts"), F.col("repeats.length").alias("_lengths"))
    joined = kept.join(
        lost, (kept["doc_id"].cast("long") == F.col("_doc")) & (F.xxhash64(kept["text"]) == F.col("_hash")), "left"
    ).drop("_doc", "_hash")
    schema = StructType([
        *kept.schema.fields, *_parse_datatype_string("n_words long, n_removed long, kept string, kept_sha256 string").fields
    ])
    shape = to_arrow_schema(schema)
    piece = re.compile(WORD.pattern + r"[\x20\x09-\x0D]*") if spaces else WORD
    place, width = kept.columns.index("text"), len(kept.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, whole, starts, lengths in zip(batch.column(place), *batch.columns[width : width + 3]):
                words = piece.findall(text.as_py() or "")
                n = len(words)
                if whole.as_py():
                    words = []
                elif starts.is_valid and len(starts):
                    cover = np.zeros(n + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + lengths.values.to_numpy(), -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(cover[:n]) == 0).tolist()]
                left = "".join(words).rstrip() if spaces else " ".join(words)
                raw = left.encode("utf-8", "surrogatepass")
                out.append((n, n - len(words), left, hashlib.sha256(raw).hexdigest()))
            columns = [pa.array(c, shape.field(width + k).type) for k, c in enumerate(zip(*out))] if out else [
                pa.array([], shape.field(width + k).type) for k in range(4)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], schema=shape)

    return joined.mapInArrow(tidied(cut), schema)

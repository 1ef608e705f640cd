"""Pages of repeated keywords, links or tags, found by labelling their lines with a hidden Markov model.

What is seen of a line knows no language and no words: shares of links, marks and separators, how often the page repeats the
line's words, whether it has the form of sentences, how long its words are.  The model starts from a documented prior and is fitted
to the corpus at hand by Baum-Welch on a bounded sample of its pages (:func:`fit`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("prose", "link list", "tag list", "menu")
#: The hidden states, and the label of each: repeated keywords and lists of short items are tag lists too.
STATES = ("prose", "links", "tags", "keywords", "items", "crumbs")
LABEL_OF = np.array([0, 1, 2, 2, 2, 3])

# ---- what is seen of a line

#: Scripts written without blanks between words: their words are pairs of characters.
_WIDE = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿\U00020000-\U0003ffff]")
_WIDE_RUN = re.compile(rf"{_WIDE.pattern}+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LINK = re.compile(r"<a\b[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|(?<![\w@])(?:[\w-]+\.)+[a-z]{2,}/\S*", re.IGNORECASE)
_TAG = re.compile(r"(?<!\w)#\w+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ _]+){3,}[^\W_](?![^\W_])")
_LEET = re.compile(r"\b[^\W\d_]+\d+[^\W\d_]\w*\b")
#: Ends of sentences of many scripts.
_STOP = re.compile(r"[.!?…؟۔।॥։።。！？](?:(?<=[。！？])[。！？」』]*|(?<=\w\w.)[.!?…\"'”’»)\]]*(?=\s+[^\W\d]|\s*$))")
_CRUMB = re.compile(r"\s(?:>|›|»|::)\s")
_COMMAS = ",;、，；"
_SEPARATORS = ("|", "·", "•", "*", "/", " - ", " – ", " — ")
_CODE = "()[]{}<>=_\\+&\"`"
_DIGIT_INSIDE = re.compile(r"[0-9][^\W\d_]")
_CUT = re.compile(r"(?<=\w\w[.!?])\s+(?=[^\W\d])|(?<=[。！？])")
_ANCHOR_END = re.compile(r"(</a>(?:\s*<br\s*/?>)?)", re.IGNORECASE)
_COUNTED = re.compile(r"\(\d+\)")
_MOST_LINE = 250


@dataclass(frozen=True)
class Feature:
    """A feature of a line: cut into values at ``edges``; a line that does not have it has value -1 and tells nothing by it."""

    name: str
    edges: tuple[float, ...]
    #: For each state how likely each value is before anything was seen.
    prior: tuple[tuple[float, ...], ...]
    #: What defines a state is not fitted: else a state could come to mean something else.
    fitted: bool = True

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), -1, np.searchsorted(self.edges, x, "right")).astype(np.int8)


# The prior, by state: prose, links, tags, keywords, items, crumbs.
FEATURES = (
    Feature("share of links", (0.001, 0.3, 0.6), ((0.93, 0.05, 0.01, 0.01), (0.02, 0.06, 0.16, 0.76), *[(0.95, 0.03, 0.01, 0.01)] * 4), False),
    Feature("share of tags", (0.01, 0.3), ((0.97, 0.025, 0.005), (0.97, 0.02, 0.01), (0.03, 0.07, 0.9), *[(0.97, 0.02, 0.01)] * 3), False),
    Feature("separators a word", (0.03, 0.12, 0.25), ((0.9, 0.085, 0.01, 0.005), (0.6, 0.1, 0.1, 0.2), (0.8, 0.1, 0.05, 0.05), (0.75, 0.1, 0.08, 0.07), (0.15, 0.1, 0.25, 0.5), (0.5, 0.15, 0.15, 0.2)), False),
    Feature("commas a word", (0.08, 0.2, 0.35), ((0.6, 0.34, 0.05, 0.01), (0.7, 0.15, 0.05, 0.1), (0.8, 0.1, 0.05, 0.05), (0.6, 0.18, 0.12, 0.1), (0.5, 0.05, 0.1, 0.35), (0.8, 0.1, 0.05, 0.05)), False),
    Feature("share of letters in words the page repeats", (0.2, 0.4, 0.6, 0.8), ((0.56, 0.28, 0.12, 0.03, 0.01), (0.5, 0.2, 0.14, 0.1, 0.06), (0.4, 0.15, 0.15, 0.15, 0.15), (0.02, 0.05, 0.15, 0.3, 0.48), (0.3, 0.2, 0.18, 0.16, 0.16), (0.2, 0.15, 0.2, 0.2, 0.25))),
    Feature("share of the line's leading word on the page", (0.08, 0.14), ((0.9, 0.08, 0.02), (0.7, 0.15, 0.15), (0.7, 0.15, 0.15), (0.4, 0.3, 0.3), (0.6, 0.2, 0.2), (0.6, 0.2, 0.2))),
    Feature("different words", (0.4, 0.6, 0.8), ((0.005, 0.03, 0.2, 0.465), (0.05, 0.05, 0.1, 0.3), (0.05, 0.1, 0.2, 0.4), (0.3, 0.25, 0.12, 0.05), (0.1, 0.15, 0.25, 0.2), (0.12, 0.14, 0.14, 0.2))),
    Feature("words a sentence", (4.0, 1000.0), ((0.05, 0.55, 0.4), (0.02, 0.06, 0.92), (0.02, 0.03, 0.95), (0.08, 0.2, 0.72), (0.07, 0.08, 0.85), (0.03, 0.05, 0.92)), False),
    Feature("share of short words", (0.1, 0.25), ((0.12, 0.28, 0.45), (0.28, 0.1, 0.1), (0.55, 0.15, 0.05), (0.4, 0.22, 0.13), (0.3, 0.25, 0.2), (0.4, 0.16, 0.09))),
    Feature("words", (3, 6, 12), ((0.15, 0.15, 0.25, 0.45), (0.5, 0.2, 0.15, 0.15), (0.2, 0.2, 0.25, 0.35), (0.25, 0.2, 0.2, 0.35), (0.15, 0.2, 0.25, 0.4), (0.2, 0.25, 0.3, 0.25)), False),
    Feature("short lines in a row", (1, 6, 12), ((0.75, 0.17, 0.05, 0.03), (0.3, 0.2, 0.2, 0.3), (0.6, 0.1, 0.1, 0.2), (0.6, 0.1, 0.1, 0.2), (0.5, 0.1, 0.15, 0.25), (0.5, 0.1, 0.15, 0.25)), False),
    Feature("disguised words", (0.15,), ((0.995, 0.005), (0.97, 0.03), (0.9, 0.1), (0.6, 0.4), (0.9, 0.1), (0.97, 0.03))),
    Feature("bread crumbs", (2,), ((0.998, 0.002), (0.98, 0.02), (0.98, 0.02), (0.98, 0.02), (0.98, 0.02), (0.05, 0.95)), False),
    Feature("marks of code", (0.06, 0.12), ((0.75, 0.1, 0.15), (0.85, 0.13, 0.02), (0.95, 0.04, 0.01), (0.95, 0.04, 0.01), (0.93, 0.06, 0.01), (0.88, 0.1, 0.02)), False),
)
START = np.array([0.6, 0.08, 0.08, 0.08, 0.08, 0.08])
STAY = 0.85


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; of scripts without blanks, pairs of characters."""
    out = []
    for run in _WORD.findall(text.lower()):
        if run.isascii() or not _WIDE.search(run):
            out.append(run)
            continue
        at = 0
        for m in _WIDE_RUN.finditer(run):
            if m.start() > at:
                out.append(run[at : m.start()])
            wide = m[0]
            out += [wide[i : i + 2] for i in range(len(wide) - 1)] or [wide]
            at = m.end()
        if at < len(run):
            out.append(run[at:])
    return out


def lines_of(text: str) -> list[str]:
    """The non-blank lines of a text; long ones are cut after anchors and sentences, or else at blanks."""
    out = []
    for line in _ANCHOR_END.sub(r"\1\n", text).splitlines():
        line = line.strip()
        if not line:
            continue
        if len(line) <= _MOST_LINE:
            out.append(line)
            continue
        piece = ""
        for part in _CUT.split(line):
            start = 0
            while len(part) - start > 2 * _MOST_LINE:
                if piece:
                    out.append(piece)
                    piece = ""
                at = part.rfind(" ", start + 1, start + _MOST_LINE)
                at = start + _MOST_LINE if at < 0 else at
                out.append(part[start:at].strip())
                start = at
            part = part[start:].strip()
            if piece and len(piece) + len(part) > _MOST_LINE:
                out.append(piece)
                piece = ""
            piece = f"{piece} {part}" if piece else part
        out.append(piece)
    return [x for x in out if x]


def measure(lines: list[str]) -> list[tuple]:
    """The features of the lines of a page, before they are cut into values; nan where a line does not have one."""
    rest, linked, words, wide = [], [], [], []
    for line in lines:
        low, n = line, 0
        if "/" in line or "<" in line or "](" in line or "www." in line:
            low, n = _LINK.subn(" ", line)
        rest.append(low)
        linked.append((len(line) - len(low) + n) / len(line) if n else 0.0)
        words.append(words_of(low))
        wide.append(not low.isascii() and _WIDE.search(low) is not None)
    # a long line that stands on the page again and again is counted once
    counts: Counter[str] = Counter()
    seen: set[str] = set()
    for line, w in zip(rest, words, strict=True):
        if len(w) < 8 or line not in seen:
            seen.add(line)
            counts.update(w)
    whole = sum(counts.values())
    often = 3 + 0.012 * whole
    out = []
    run = 0
    for line, w, link, is_wide in zip(rest, words, linked, wide, strict=True):
        n = len(w)
        letters = repeated = leading = small = single = 0
        for x in w:
            k = len(x)
            letters += k
            if k > 3 or is_wide:
                c = counts[x]
                if c >= often:
                    repeated += k
                if c > leading:
                    leading = c
            else:
                small += 1
                single += k == 1
        stops = len(_STOP.findall(line))
        tags = len(_TAG.findall(line)) if "#" in line else 0
        counted = len(_COUNTED.findall(line)) if "(" in line else 0
        marks = sum(map(line.count, _SEPARATORS)) + counted
        commas = sum(map(line.count, _COMMAS))
        crumbs = len(_CRUMB.findall(line)) if ">" in line or "::" in line or "›" in line or "»" in line else 0
        code = max(0, sum(map(line.count, _CODE)) - crumbs - 2 * counted) / max(1, len(line) - line.count(" "))
        disguised = 0.0
        if single >= 4 and " " in line:
            disguised = sum(map(len, _SPACED.findall(line))) / len(line)
        if n and _DIGIT_INSIDE.search(line):
            disguised += len(_LEET.findall(line)) / n
        run = run + 1 if n <= 5 and not stops and (code < 0.06 or link > 0) else 0
        if run > 1:
            for back in range(2, run + 1) if run in _RUNS else ():
                out[-back + 1][_RUN] = run
        out.append([
            link, tags / (n or 1), marks / (n or 1) if marks > 1 or n <= 5 else 0.0, commas / (n or 1) if commas > 1 else 0.0, repeated / letters if letters else _NAN,
            leading / whole if whole >= 30 else _NAN, len(set(w)) / n if n >= 8 else _NAN, n / stops if stops else np.inf, small / n if n >= 4 and not is_wide and disguised < 0.15 else _NAN,
            n, run and max(run, out[-1][_RUN] if run > 1 else 0), disguised, crumbs, code if link < 0.3 else _NAN,
        ])
    return out


_NAN = float("nan")
_LENGTH, _RUN = (next(k for k, f in enumerate(FEATURES) if f.name == name) for name in ("words", "short lines in a row"))
_RUNS = frozenset(FEATURES[_RUN].edges)


def cut(measured: list[tuple]) -> np.ndarray:
    """The values of all features, a row per line."""
    x = np.array(measured, float).reshape(-1, len(FEATURES))
    return np.stack([f.values(x[:, k]) for k, f in enumerate(FEATURES)], 1)


def observe(lines: list[str]) -> np.ndarray:
    return cut(measure(lines))


# ---- the model

LONG = 1.5


@dataclass(frozen=True)
class Model:
    """Logarithms: ``start`` by state, ``move`` from state to state, ``emit`` by feature, state and value."""

    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """The log likelihood of each line under each state; a long line stands for more than one."""
        total = sum(np.where(seen[:, k : k + 1] < 0, 0.0, e[:, seen[:, k]].T) for k, e in enumerate(self.emit))
        return total * np.where(seen[:, _LENGTH] == len(FEATURES[_LENGTH].edges), LONG, 1.0)[:, None]


def _logs(p) -> np.ndarray:
    p = np.asarray(p, float) + 1e-3
    return np.log(p / p.sum(-1, keepdims=True))


def prior() -> Model:
    k = len(STATES)
    return Model(_logs(START), _logs(np.full((k, k), (1 - STAY) / (k - 1)) + np.eye(k) * (STAY - (1 - STAY) / (k - 1))), tuple(_logs(f.prior) for f in FEATURES))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def fit(pages: list[np.ndarray], rounds: int = 5, weight: float = 300.0) -> Model:
    """The model fitted to the lines of pages without labels (Baum-Welch); the prior counts as ``weight`` lines of each state."""
    first = model = prior()
    for _ in range(rounds):
        start = np.exp(first.start) * weight / 10
        move = np.exp(first.move) * weight
        emit = [np.exp(e) * weight for e in first.emit]
        for seen in pages:
            score = model.scores(seen)
            n = len(seen)
            ahead = np.empty_like(score)
            ahead[0] = model.start + score[0]
            for t in range(1, n):
                ahead[t] = _log_sum(ahead[t - 1][:, None] + model.move, 0) + score[t]
            back = np.zeros_like(score)
            for t in range(n - 2, -1, -1):
                back[t] = _log_sum(model.move + (score[t + 1] + back[t + 1])[None, :], 1)
            whole = _log_sum(ahead[-1], 0)
            share = np.exp(ahead + back - whole)
            start += share[0]
            if n > 1:
                move += np.exp(ahead[:-1, :, None] + model.move[None] + (score[1:] + back[1:])[:, None, :] - whole).sum(0)
            for k, e in enumerate(emit):
                has = seen[:, k] >= 0
                for s in range(len(STATES)):
                    e[s] += np.bincount(seen[has, k], weights=share[has, s], minlength=e.shape[1])
        model = Model(_logs(start / start.sum()), _logs(move / move.sum(1, keepdims=True)), tuple(_logs(e / e.sum(1, keepdims=True)) if f.fitted else given for f, e, given in zip(FEATURES, emit, first.emit, strict=True)))
    return model


def label(seen: np.ndarray, model: Model) -> np.ndarray:
    """The likeliest states of a page's lines."""
    return label_pages(seen, np.array([len(seen)]), model)


def label_pages(seen: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """The likeliest states of the lines of many pages (Viterbi), a step for all pages at a time; ``sizes`` are their lines, none 0."""
    score = model.scores(seen)
    order = np.argsort(-sizes, kind="stable")
    start, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    best = model.start + score[start]
    back = np.zeros(score.shape, np.int8)
    most = int(size[0]) if len(size) else 0
    left = np.searchsorted(-size, -np.arange(most + 1), "left")  # pages of more than t lines
    for t in range(1, most):
        n = left[t]
        step = best[:n, :, None] + model.move
        at = start[:n] + t
        back[at] = step.argmax(1)
        best[:n] = step.max(1) + score[at]
    out = np.zeros(len(score), np.int64)
    state = best.argmax(1)
    for t in range(most - 1, -1, -1):
        n = left[t]
        at = start[:n] + t
        out[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return out


def label_text(text: str | None, model: Model) -> list[tuple[str, int]]:
    """``(line, label)`` of the lines of a text; labels are indexes of :data:`LABELS`."""
    lines = lines_of(text or "")
    return list(zip(lines, LABEL_OF[label(observe(lines), model)].tolist(), strict=True)) if lines else []


#: Pages that a model is fitted on, the longest of them, and the seed of their choice.
SAMPLE_PAGES, SAMPLE_CHARS = 1000, 20_000


def fitted(df: DataFrame, id_col: str, text_col: str, pages: int = SAMPLE_PAGES, longest: int = SAMPLE_CHARS) -> Model:
    """The model for a corpus: fitted on ``pages`` of its texts, those of the least hash of id and text among the texts of
    at most ``longest`` characters (the bound of what reaches the driver).  An empty corpus gives the prior."""
    text = F.col(text_col)
    some = df.select(text.alias("t"), F.shiftrightunsigned(F.xxhash64(F.col(id_col), text), 1).alias("h")).where((F.length(text) <= longest) & (F.trim(text) != ""))
    # a share of the rows that makes up a few more than are wanted, so that a task sends few
    share = min(1.0, 1.5 * pages / max(1, df.count()))
    most = min(int(share * 2**63), 2**63 - 1)
    chosen = sorted((r.h, r.t) for r in some.where(F.col("h") <= most).collect())[:pages]
    return fit([observe(lines) for _, t in chosen if (lines := lines_of(t))])


SHARES = "id bigint, n_lines int, prose double, link_list double, tag_list double, menu double, spam boolean"


def page_shares(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """``(id, n_lines, prose, link_list, tag_list, menu, spam)``: the shares of a text's characters in lines of each label.

    Lines are labelled jointly by a hidden Markov model over what is seen of them (links, separators, repetition, the form of
    sentences), so that a heading among sentences is prose and a bare word among tags is a tag.  ``spam`` where more than
    ``threshold`` of the characters of its lines are not prose.  ``model`` is fitted to ``df`` if none is given (:func:`fitted`, one
    more scan).  Each text is labelled in the task that read it; nothing is shuffled.  Null, empty and blank texts have no lines,
    shares of 0 and are no spam.  Copies get equal rows; ids may be null; other columns are not read; an empty table gives
    no rows.
    """
    model = model or fitted(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pages = [lines_of(text) if text else [] for text in texts]
            n_lines = np.array([len(lines) for lines in pages], np.int32)
            owner = np.repeat(np.arange(len(texts)), n_lines)
            seen = cut([row for lines in pages for row in measure(lines)])
            state = LABEL_OF[label_pages(seen, n_lines[n_lines > 0], model)]
            length = np.array([len(line) for lines in pages for line in lines], float)
            shares = np.bincount(state * len(texts) + owner, weights=length, minlength=len(LABELS) * len(texts)).reshape(len(LABELS), len(texts))
            total = shares.sum(0)
            shares /= np.maximum(total, 1)
            spam = (total > 0) & (shares[1:].sum(0) > threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines), *[pa.array(s) for s in shares], pa.array(spam)], ["id", "n_lines", "prose", "link_list", "tag_list", "menu", "spam"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SHARES)

"""Toxic comments by a subsequence string-kernel support vector machine with Nystrom landmarks."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only
from .pieces import give_back

#: Kernel: subsequences of three letters within SPAN letters, each letter of the span weighing DECAY.
SPAN, DECAY = 6, 0.6
#: Letters of a window; longer words are read through overlapping windows.
LETTERS = 24
#: Toxic comments that the machine is fitted on at most (and twice as many clean ones), and landmarks of either kind.
SAMPLE, LANDMARKS = 3000, 128
#: Price of errors against the width of the margin.
COST = 300.0
#: How many times likelier a window must be in toxic comments to count as telling.
TELLING = 20
#: Toxic comments that a telling window must stand in at least, however many there are.
SUPPORT = 3
#: Words whose score a Python worker remembers.
ROOM = 150_000

_OFFSETS = [(i, i + j) for i in range(1, SPAN - 1) for j in range(1, SPAN - i)]


def codes(words: list[str]) -> np.ndarray:
    """Letters as numbers 1 to 31 (a-z, then five classes of other letters), zero-padded to the longest word."""
    width = max(map(len, words))
    points = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)
    latin = (points >= 97) & (points <= 122)
    return np.where(points == 0, 0, np.where(latin, points - 96, 27 + points % 5)).astype(np.int32)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length: the three-letter subsequences' codes, one row a word, and the weight of each column."""
    c = codes(words)
    n = c.shape[1]
    cols, weights = [], []
    for i in range(n):
        for j, k in _OFFSETS:
            if i + k < n:
                cols.append((c[:, i] << 10) | (c[:, i + j] << 5) | c[:, i + k])
                weights.append(DECAY ** (k + 1))
    return np.stack(cols, 1), np.array(weights)


def features(word: str) -> dict[int, float]:
    """A word in the kernel's space, of length 1."""
    cols, weights = subsequences([word])
    u, at = np.unique(cols[0], return_inverse=True)
    v = np.bincount(at, weights)
    return dict(zip(u.tolist(), (v / np.sqrt((v**2).sum())).tolist(), strict=True))


def windows(comment: str) -> tuple[set[str], list[str]]:
    """A comment's words, and words spelled out letter by letter ("i d i o t", "i.d.i.o.t") joined again."""
    words = comment.lower().split()
    joined, run = [], ""
    if any(len(w) <= 2 for w in words):
        for w in [*words, "--end--"]:
            bare = "".join(filter(str.isalnum, w)) if len(w) <= 2 else w
            if len(bare) == 1:
                run += bare
                continue
            if len(run) > 2:
                joined.append(run)
            run = ""
    return set(words), joined


def letters(word: str) -> list[str]:
    """The windows of one word: what is not a letter or digit inside it is dropped."""
    bare = word if word.isalnum() else "".join(filter(str.isalnum, word))
    if len(bare) <= LETTERS:
        return [bare] if len(bare) > 2 else []
    step = LETTERS // 2
    return [bare[i : i + LETTERS] for i in range(0, len(bare) - LETTERS + step, step)]


@dataclass
class ToxicityModel:
    """The machine folded into one weight per subsequence, and the calibration of a comment's highest window."""

    weight: np.ndarray
    slope: float
    middle: float
    landmarks: list[str]

    def margins(self, bare: list[str]) -> np.ndarray:
        """Decision value of each window (of 3 to LETTERS letters)."""
        out = np.zeros(len(bare))
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(bare):
            by_size.setdefault(len(w), []).append(k)
        for own in by_size.values():
            for a in range(0, len(own), 1024):
                at = own[a : a + 1024]
                cols, weights = subsequences([bare[k] for k in at])
                value = (self.weight[cols] * weights).sum(1)  # row by row: the same in every batch
                order = np.argsort(cols, 1)
                sorted_cols = np.take_along_axis(cols, order, 1)
                total = np.cumsum(weights[order], 1)
                last = np.ones_like(sorted_cols, bool)
                last[:, :-1] = sorted_cols[:, 1:] != sorted_cols[:, :-1]
                # the sum of each run of equal codes, squared: what a word has in common with itself
                ends = np.where(last, total, 0)
                before = np.maximum.accumulate(np.concatenate([np.zeros((len(at), 1)), ends[:, :-1]], 1), 1)
                self_kernel = (np.where(last, total - before, 0) ** 2).sum(1)
                out[at] = value / np.sqrt(self_kernel)
        return out

    def probability(self, highest: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (highest - self.middle), -40, 40)
        return np.where(np.isfinite(highest), 1 / (1 + np.exp(-z)), 0.0)


class Scorer:
    """Highest window of each comment, with a bounded memory of words."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.memory = model, {}

    def highest(self, comments: list[str]) -> np.ndarray:
        if len(self.memory) > ROOM:
            self.memory.clear()
        memory = self.memory
        seen = []
        new: set[str] = set()
        for c in comments:
            words, joined = windows(c)
            words.update(joined)
            new |= words.difference(memory)
            seen.append(words)
        parts = [(w, p) for w in new for p in letters(w)]
        memory.update(dict.fromkeys(new, float("-inf")))
        for (w, _), v in zip(parts, self.model.margins([p for _, p in parts]).tolist() if parts else [], strict=True):
            if v > memory[w]:
                memory[w] = v
        return np.array([max(map(memory.__getitem__, s), default=float("-inf")) for s in seen])


def _first_of_copies(bags: list[list[str]]) -> list[int]:
    """One comment of each group of near copies (two of four minimum hashes agree), so that their words don't seem common."""
    factors = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint64)
    seen: list[set[int]] = [set() for _ in factors]
    out = []
    for i, bag in enumerate(bags):
        if bag:
            h = np.array([zlib.crc32(w.encode()) for w in bag], np.uint64)
            least = ((h[:, None] * factors) & np.uint64(0xFFFFFFFF)).min(0).tolist()
            copies = sum(v in s for v, s in zip(least, seen, strict=True)) >= 2
            for v, s in zip(least, seen, strict=True):
                s.add(v)
            if copies:
                continue
        out.append(i)
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, steps: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last coordinate of x is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        active = np.flatnonzero(y * (x @ w) < 1)
        left, right = ridge.copy(), np.zeros(x.shape[1])
        for a in range(0, len(active), 1024):  # slice by slice: the rows in use are never copied as a whole
            at = active[a : a + 1024]
            xa, ca = x[at].astype(float), cost * weight[at]
            left += (xa * ca[:, None]).T @ xa
            right += xa.T @ (ca * y[at])
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def fit(comments: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 3, seed: int = 5) -> ToxicityModel:
    """Fit on labelled comments.

    A comment's label holds for its sentences only as a whole: a toxic comment has some toxic window, a clean one has none.
    So the machine is trained on windows, the telling ones (or the strongest) of each toxic comment against those of clean
    ones (the hardest are added), and they are chosen anew for some rounds. Landmarks are the windows that tell the
    classes apart most, the commonest clean ones, and others at random.
    """
    rng = np.random.default_rng(seed)
    bags = []
    one: dict[str, str] = {}  # equal words are one object
    for c in comments:
        words, joined = windows(c)
        bags.append(sorted({one.setdefault(p, p) for w in [*words, *joined] for p in letters(w)}))
    first = _first_of_copies(bags)
    bags, toxic = [bags[i] for i in first], toxic[first]
    hit, miss = Counter(), Counter()
    for bag, t in zip(bags, toxic.tolist(), strict=True):
        (hit if t else miss).update(bag)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    if not hit:
        return ToxicityModel(np.zeros(1 << 15), 1.0, 5.0, [])  # nothing known to be toxic

    def lean(w: str) -> float:
        p, q = (hit[w] + 0.1) / (n1 + 0.2), (miss[w] + 0.1) / (n0 + 0.2)
        return hit[w] * np.log(p / q)

    ranked = sorted(hit, key=lambda w: (-lean(w), w))
    others = sorted(miss)
    common = sorted(miss, key=lambda w: (-miss[w], w))
    chosen = ranked[:landmarks] + common[: landmarks // 2] + [others[i] for i in rng.permutation(len(others))[: landmarks // 2]]
    chosen = sorted(set(chosen))
    marks = [features(w) for w in chosen]
    used = sorted(set().union(*marks))  # only subsequences of some landmark matter
    column = {u: i for i, u in enumerate(used)}
    space = np.zeros((len(chosen), len(used)), np.float32)
    for k, f in enumerate(marks):
        space[k, [column[u] for u in f]] = list(f.values())
    gram = (space @ space.T).astype(float)
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystrom: z(w) = root' k(landmarks, w)
    to_z = space.T @ root.astype(np.float32)
    del space, marks
    images: dict[str, np.ndarray] = {}

    def z(bare: list[str]) -> np.ndarray:
        out = np.ones((len(bare), to_z.shape[1] + 1), np.float32)
        for k, w in enumerate(bare):
            if w not in images:
                own = [(column[u], v) for u, v in features(w).items() if u in column]
                images[w] = np.array([v for _, v in own], np.float32) @ to_z[[c for c, _ in own]]
            out[k, :-1] = images[w]
        return out

    # windows of several toxic comments that clean ones hardly have count in each of them; else the strongest stands in
    telling = {w for w in hit if hit[w] >= SUPPORT and (hit[w] + 0.1) * (n0 + 0.2) >= TELLING * (miss[w] + 0.1) * (n1 + 0.2)}

    def positives(value) -> list[str]:
        out: list[str] = []
        for bag, t in zip(bags, toxic.tolist(), strict=True):
            if t and bag:
                out += [w for w in bag if w in telling] or [max(bag, key=lambda w: (value(w), w))]
        return out

    strongest = positives(lean)
    against = sorted({*common[:SAMPLE], *(others[i] for i in rng.permutation(len(others))[: 2 * SAMPLE])}) or ["abc"]
    model = ToxicityModel(np.zeros(1 << 15), 1.0, 0.0, chosen)
    for _ in range(rounds):
        pos = Counter(strongest)
        neg = Counter(against)
        x = z([*pos, *neg])
        y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
        # a window weighs as many comments of its class as it would decide wrongly
        weight = np.array([*(c / n1 for c in pos.values()), *((1 + miss[v]) / n0 for v in neg)])
        w = _machine(x, y, weight, cost=COST)
        model.weight[used] = to_z @ w[:-1]
        every = sorted({p for b in bags for p in b})
        margin = dict(zip(every, (model.margins(every) + w[-1]).tolist(), strict=True))
        strongest = positives(margin.__getitem__)
        hard = sorted(others, key=lambda q: (-margin[q], q))[: SAMPLE // 2]
        against = sorted({*against, *hard})
    top = np.array([max((margin[p] for p in b), default=-np.inf) for b in bags]) - w[-1]
    ok = np.isfinite(top)
    model.slope, model.middle = _calibrate(top[ok], toxic[ok].astype(float))
    if ok.any() and 0 < toxic[ok].sum() < ok.sum():  # drawn towards the middle of the gap between the classes' tails
        gap = np.quantile(top[ok & (toxic == 0)], 0.999), np.quantile(top[ok & (toxic == 1)], 0.02)
        model.middle = (model.middle + sum(gap) / 2) / 2
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve through scores and labels, labels drawn in a little so that it stays finite."""
    if not len(x) or y.min() == y.max():
        return 1.0, float(x.max() + 5 if len(x) and not y.max() else -5)
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    scale, shift = x.std() or 1.0, x.mean()
    u = np.stack([(x - shift) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -40, 40)))
        h = (u * (p * (1 - p) + 1e-9)[:, None]).T @ u + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, u.T @ (goal - p) - 1e-6 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0] / scale, 1e-6)
    return float(slope), float(shift - w[1] / slope)


def train(feedback: DataFrame, labels: DataFrame, feedback_id: str = "feedback_id", comment: str = "comment", most: int = SAMPLE) -> ToxicityModel:
    """Fit on ``feedback(feedback_id, comment)`` with ``labels(feedback_id, toxic)``.

    At most ``most`` toxic and twice as many clean comments are used, those with the smallest hashes of their ids; that sample goes to
    the driver. Null labels and comments are left out; of repeated ids the larger label holds. Labels, and nothing else
    of the comment's record, are read beside the text.
    """
    known = labels.groupBy(F.col("feedback_id").alias("known")).agg(F.max("toxic").alias("toxic")).filter("toxic is not null and known is not null")
    picked = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("known"), "known").limit((2 - t) * most) for t in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    r = only(feedback, id=feedback_id, comment=comment).filter("comment is not null")
    rows = r.join(F.broadcast(picked), F.col("id") == F.col("known")).select("known", "comment", "toxic").toPandas()
    rows = rows.sort_values(["known", "comment"]).drop_duplicates("known")
    comments, toxic = rows.comment.tolist(), rows.toxic.to_numpy(int)
    del rows
    model = fit(comments, toxic)
    del comments
    give_back()  # the driver lives on
    return model


def score_comments(
    feedback: DataFrame, model: ToxicityModel, feedback_id: str = "feedback_id", comment: str = "comment", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``feedback(feedback_id, comment)`` -> ``(feedback_id, score)``, 0 to 1, higher: likelier toxic.

    The score of a comment is that of its most toxic window. Null, empty and wordless comments score 0; null and repeated
    ids stay rows of their own; an empty table gives an empty one; other columns are ignored, but with ``carry`` the result
    also has ``comment`` and a struct ``carried`` of the named columns. The whole text is read. No shuffle; the model (one
    weight per subsequence, 256 KB) travels with the tasks.
    """
    also = [F.struct(*[feedback[f"`{c}`"].alias(c) for c in carry]).alias("carried")] if carry else []
    r = feedback.select(feedback[f"`{feedback_id}`"].alias("feedback_id"), feedback[f"`{comment}`"].alias("comment"), *also)
    names = ["feedback_id", *(["comment", "carried"] if carry else []), "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            parts = [b.column(1).slice(a, 256).to_pylist() for a in range(0, b.num_rows, 256)]
            top = np.concatenate([scorer.highest([c or "" for c in part]) for part in parts] or [np.zeros(0)])
            kept = b.columns if carry else b.columns[:1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.probability(top))], names)
        del scorer
        give_back()

    kinds = {f.name: f.dataType.simpleString() for f in r.schema.fields} | {"score": "double"}
    return r.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))

"""Alignment of lines with passages of a commentary: neighbour scores by windows, and three whole-group algorithms.

A monotone path, its reverse and a conflict-free assignment need a group's rows together; a group is one text with its
commentary, whose size is that of the texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bonus for a gap of so many segments between the targets of neighbouring lines; fixed values
GAP_BONUS = {0: 0.12, 1: 0.08, 2: 0.04}
ASSIGNMENT_BONUS, CEILING, STATES, CHOICES = 0.06, 0.99, 500, 8


def transition(previous: tuple[int, int], current: tuple[int, int], reverse: bool = False) -> float | None:
    """Bonus of moving from one target (first, last segment) to the next, None if it would go back."""
    gap = previous[0] - current[1] - 1 if reverse else current[0] - previous[1] - 1
    return None if gap < 0 else GAP_BONUS.get(gap, 0.0)


def monotone_path(candidates: list[list[tuple[int, int, float]]], reverse: bool = False) -> list[int]:
    """Index of each line's target on the best path in order; the first of equal ones. candidates: (first, last, score) by line."""
    totals = [c[2] for c in candidates[0]]
    links: list[list[int | None]] = []
    for before, line in zip(candidates, candidates[1:], strict=False):
        best: list[tuple[float, int | None]] = []
        for first, last, score in line:
            steps = [(totals[i] + score + bonus, -i) for i, p in enumerate(before) if (bonus := transition(p[:2], (first, last), reverse)) is not None]
            top = max(steps, default=None)
            best.append((top[0], -top[1]) if top else (-1_000_000.0, None))
        totals = [b[0] for b in best]
        links.append([b[1] for b in best])
    history = [[c[2] for c in candidates[0]]]
    for before, line, link in zip(candidates, candidates[1:], links, strict=False):
        history.append([(history[-1][k] + c[2] + transition(before[k][:2], c[:2], reverse)) if k is not None else -1_000_000.0 for c, k in zip(line, link, strict=True)])
    at = max(range(len(totals)), key=totals.__getitem__)
    path = [at]
    for row in range(len(links) - 1, -1, -1):
        back = links[row][path[-1]]
        path.append(max(range(len(history[row])), key=history[row].__getitem__) if back is None else back)
    return path[::-1]


def assignment(candidates: list[list[tuple[int, int, float]]]) -> list[int] | None:
    """Targets that don't overlap, by a beam of the best partial choices; None if there are none."""
    beam: list[tuple[float, list[int]]] = [(0.0, [])]
    for line in candidates:
        grown = []
        for score, chosen in beam:
            taken = [candidates[i][k] for i, k in enumerate(chosen)]
            for k, (first, last, own) in enumerate(line[:CHOICES]):
                if all(last < t[0] or t[1] < first for t in taken):
                    grown.append((score + own, [*chosen, k]))
        if not grown:
            return None
        beam = sorted(grown, key=lambda s: -s[0])[:STATES]
    return beam[0][1]


def align_group(rows: pd.DataFrame) -> pd.DataFrame:
    """The chosen target and final score of each line of a group. rows: group, line_no, first, last, score, candidates ranked by line."""
    rows = rows.sort_values(["line_no", "score", "first", "last"], ascending=[True, False, True, True])
    lines, candidates = [], []
    for line, own in rows.groupby("line_no", sort=True):
        lines.append(line)
        candidates.append(list(zip(own["first"], own["last"], own["score"], strict=True)))
    options = []
    for method, reverse in (("forward", False), ("reverse", True)):
        path = monotone_path(candidates, reverse)
        picks = [candidates[i][k] for i, k in enumerate(path)]
        scores = []
        for i, (first, last, score) in enumerate(picks):
            before = transition(picks[i - 1][:2], (first, last), reverse) if i else 0.0
            after = transition((first, last), picks[i + 1][:2], reverse) if i + 1 < len(picks) else 0.0
            scores.append(min(CEILING, score + max(before or 0.0, after or 0.0, 0.0)))
        options.append((sum(scores), method, picks, scores))
    if (chosen := assignment(candidates)) is not None:
        picks = [candidates[i][k] for i, k in enumerate(chosen)]
        scores = [min(CEILING, p[2] + ASSIGNMENT_BONUS) for p in picks]
        options.append((sum(scores), "assignment", picks, scores))
    _, method, picks, scores = max(options, key=lambda o: o[0])
    return pd.DataFrame({"group": rows["group"].iloc[0], "line_no": lines, "first": [p[0] for p in picks], "last": [p[1] for p in picks], "score": scores, "method": method})


def align(candidates: DataFrame) -> DataFrame:
    """group, line_no, first, last, score, method from scored candidates (group, line_no, first, last, score)."""
    return candidates.groupBy("group").applyInPandas(align_group, "group bigint, line_no bigint, first bigint, last bigint, score double, method string")


def neighbours(rows: DataFrame, group: str, order: str, target: str) -> DataFrame:
    """rows with previous_target, next_target and coherent: whether the target lies between its neighbours'."""
    w = Window.partitionBy(group).orderBy(order)
    rows = rows.withColumns({"previous_target": F.lag(target).over(w), "next_target": F.lead(target).over(w)})
    fits = (F.col("previous_target").isNull() | (F.col("previous_target") <= F.col(target))) & (F.col("next_target").isNull() | (F.col(target) <= F.col("next_target")))
    return rows.withColumn("coherent", fits)


def direction(rows: DataFrame, group: str, order: str, target: str) -> DataFrame:
    """group, n, direction: forward unless most neighbouring targets decrease; forward below three rows."""
    after = F.lead(target).over(Window.partitionBy(group).orderBy(order))
    counts = rows.withColumn("_next", after).groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("_next") >= F.col(target)).alias("up"), F.count_if(F.col("_next") < F.col(target)).alias("down"))
    return counts.select(group, "n", F.when((F.col("n") < 3) | (F.col("up") >= F.col("down")), "forward").otherwise("reverse").alias("direction"))


def hard_negatives(rows: DataFrame, group: str, order: str, source: str, target: str) -> DataFrame:
    """Each row with the next row's target in place of its own, where those differ."""
    after = F.lead(target).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("negative_target", after).where(F.col("negative_target").isNotNull() & (F.col("negative_target") != F.col(target))).select(group, order, source, "negative_target")


#: Second path search, over targets by their characters: bonus by gap up to so many characters, beyond them, for a target again, out
#: of order, and for each step; how much better the reverse order must be; weights of an adjusted score; fixed values
GAP_CHARS, FAR, AGAIN, BACK, STEP, REVERSE_MARGIN = ((3, 0.10), (80, 0.06)), 0.02, -0.16, -0.30, 0.03, 0.08
NEIGHBOUR_WEIGHT, FAMILY_WEIGHT, FAMILY_CONFLICT = 0.10, 0.06, 0.15


def character_step(starts: np.ndarray, ends: np.ndarray, at: int, to: int, reverse: bool) -> np.ndarray:
    """Bonus of moving from each of the targets (starts, ends) to the one at [at, to)."""
    gap = starts - to if reverse else at - ends
    out = np.full(len(starts), FAR)
    for most, bonus in reversed(GAP_CHARS):
        out[gap <= most] = bonus
    out[gap < 0] = BACK
    out[(starts == at) & (ends == to)] = AGAIN
    return out


def character_path(lines: list[np.ndarray], reverse: bool = False) -> tuple[list[int], float]:
    """The best target of each line, the first of equal ones, and the path's mean score. lines: arrays of rows (start, end, score)."""
    if not lines or any(not len(x) for x in lines):
        return [], 0.0
    totals, links = lines[0][:, 2].astype(float), []
    for before, line in zip(lines, lines[1:], strict=False):
        steps = np.stack([totals + character_step(before[:, 0], before[:, 1], a, b, reverse) for a, b in line[:, :2]]) + STEP
        links.append(steps.argmax(axis=1))
        totals = steps.max(axis=1) + line[:, 2]
    path = [int(totals.argmax())]
    for link in reversed(links):
        path.append(int(link[path[-1]]))
    return path[::-1], round(float(totals.max()) / len(lines), 4)


def _window(place: float, before: float | None, after: float | None, anchors: tuple[float, float]) -> float:
    """How a target lies among its neighbours': between them, beside one, or alone."""
    if before is not None and after is not None:
        return 1.0 if min(before, after) <= place <= max(before, after) else 0.2
    return max(anchors) if before is not None or after is not None else 0.5


def assigned_group(rows: pd.DataFrame) -> pd.DataFrame:
    """The chosen target of each line of a group by the better of the two orders, with its adjusted score and margin to the next best one.

    rows: group, line_no, start, end, score, family, and support (evidence that is not order) if there is any. The adjusted score adds the neighbourhood, and the relation's family where a
    neighbour shares it or none is there to share it; a family that no neighbour has costs.
    """
    rows = rows.sort_values(["line_no", "score", "start", "end"], ascending=[True, False, True, True])
    by_line = [own for _, own in rows.groupby("line_no", sort=True)]
    lines = [own[["start", "end", "score"]].to_numpy(float) for own in by_line]
    support = [np.minimum(0.12, 0.12 * own["support"].to_numpy(float)) if "support" in own else np.zeros(len(own)) for own in by_line]
    families = [own["family"].iloc[0] for own in by_line]
    (forward, f), (back, r) = character_path(lines), character_path(lines, True)
    reverse = r > f + REVERSE_MARGIN
    path = back if reverse else forward
    chosen = [lines[i][k] for i, k in enumerate(path)]
    out = []
    for i, line in enumerate(lines):
        before, after = chosen[i - 1] if i else None, chosen[i + 1] if i + 1 < len(lines) else None
        around = [families[k] for k in (i - 1, i + 1) if 0 <= k < len(lines)]
        family = FAMILY_WEIGHT if families[i] in around else FAMILY_WEIGHT * 0.5 if not around else FAMILY_WEIGHT * 0.25 - FAMILY_CONFLICT
        scores = []
        for (a, b, score), more in zip(line, support[i], strict=True):
            left = 0.0 if before is None else float(np.clip(character_step(before[:1], before[1:2], a, b, False)[0] + 0.30, 0, 1)) if a >= before[0] else 0.15
            right = 0.0 if after is None else float(np.clip(character_step(np.array([a]), np.array([b]), after[0], after[1], False)[0] + 0.30, 0, 1)) if a <= after[0] else 0.15
            near = _window(a, None if before is None else before[0], None if after is None else after[0], (left, right))
            scores.append(round(score + NEIGHBOUR_WEIGHT * near + family + more, 4))
        own = scores[path[i]]
        rest = [s for k, s in enumerate(scores) if not (line[k, 0] == chosen[i][0] and line[k, 1] == chosen[i][1])]
        second = max(rest, default=0.0)
        out.append((rows["group"].iloc[0], by_line[i]["line_no"].iloc[0], int(chosen[i][0]), int(chosen[i][1]), own, second, round(own - second, 4), "global_reverse" if reverse else "global_forward"))
    return pd.DataFrame(out, columns=["group", "line_no", "start", "end", "score", "second_score", "margin", "method"])


def assigned(candidates: DataFrame) -> DataFrame:
    """group, line_no, start, end, score, second_score, margin, method from candidates (group, line_no, start, end, score, family)."""
    return candidates.groupBy("group").applyInPandas(assigned_group, "group bigint, line_no bigint, start bigint, end bigint, score double, second_score double, margin double, method string")


def reuse_reason(count: Column, relation: Column, split_parent: Column, source_tokens: Column, target_tokens: Column, broad: float = 6.0) -> Column:
    """Why several links may aim at one target, or that it is suspicious: one link only, whole lines, parts of a split, a target that is a broad context."""
    return (
        F.when(count <= 1, "unique_target").when(relation == "explains_line", "explains_line_allows_shared_target").when(F.coalesce(split_parent, F.lit("")) != "", "split_parent_allows_shared_target")
        .when(target_tokens / F.greatest(F.lit(1), source_tokens) >= broad, "broad_context_target_reuse_reviewed").otherwise("suspicious_target_reuse")
    )

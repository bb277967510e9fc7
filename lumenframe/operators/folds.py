"""Order-dependent operators: one key's rows go through a fold in Python, by applyInPandas.

Each is bounded by the rows of one key (a frame, a user, a track), which is the unit that the fold needs whole.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(user, id, at, allowed) of requests(user, id, at in seconds): a bucket of burst tokens that fills by rate a second."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, last, out = burst, None, []
        rows = rows.sort_values(["at", "id"])
        for at in rows["at"]:
            tokens = min(burst, tokens + (at - last) * rate) if last is not None else tokens
            last = at
            out.append(tokens >= 1)
            tokens -= tokens >= 1
        return rows.assign(allowed=out)[["user", "id", "at", "allowed"]]

    return requests.select("user", "id", "at").groupBy("user").applyInPandas(run, "user long, id long, at double, allowed boolean")


def sliding_quota(requests: DataFrame, most: int, window: float, reject_after: int) -> DataFrame:
    """(user, id, at, decision): allow while fewer than most accepted requests lie in the window before, then throttle, and reject after so many throttled in a row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        accepted: list[float] = []
        denied, out = 0, []
        rows = rows.sort_values(["at", "id"])
        for at in rows["at"]:
            accepted = [x for x in accepted if at - x < window]
            if len(accepted) < most:
                accepted.append(at)
                denied = 0
                out.append("allow")
            else:
                denied += 1
                out.append("throttle" if denied <= reject_after else "reject")
        return rows.assign(decision=out)[["user", "id", "at", "decision"]]

    return requests.select("user", "id", "at").groupBy("user").applyInPandas(run, "user long, id long, at double, decision string")


def suppress_overlaps(boxes: DataFrame, threshold: float) -> DataFrame:
    """Boxes(frame, id, x, y, w, h, score) that greedy non-max suppression keeps: by score, then id."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        kept: list = []
        for b in rows.itertuples():
            def iou(k, b=b) -> float:
                w = max(0.0, min(b.x + b.w, k.x + k.w) - max(b.x, k.x))
                h = max(0.0, min(b.y + b.h, k.y + k.h) - max(b.y, k.y))
                union = b.w * b.h + k.w * k.h - w * h
                return w * h / union if union > 0 else 0.0

            if all(iou(k) <= threshold for k in kept):
                kept.append(b)
        return rows.loc[[k.Index for k in kept]]

    return boxes.groupBy("frame").applyInPandas(run, boxes.schema)


def merge_tracks(cues: DataFrame, policy: str) -> DataFrame:
    """Cues(track, id, s, e, source) of several sources in one track, in order of start.

    policy: keep_all, drop (a cue that overlaps a kept one goes), prefer_first or prefer_last (of two that overlap, the earlier or later in order stays).
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["s", "source", "id"])
        if policy == "keep_all":
            return rows
        kept: list = []
        for cue in rows.itertuples():
            clash = bool(kept) and cue.s < kept[-1].e
            if clash and policy == "prefer_last":
                kept[-1] = cue
            elif not clash:
                kept.append(cue)
        return rows.loc[[k.Index for k in kept]]

    return cues.groupBy("track").applyInPandas(run, cues.schema)


def group_scenes(shots: DataFrame, threshold: float, least: int) -> DataFrame:
    """shots(video, i, distance) with scene: a new one at a distance over the threshold once the scene has least shots."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        scene, size, out = 0, 0, []
        rows = rows.sort_values("i")
        for d in rows["distance"]:
            if size >= least and d > threshold:
                scene, size = scene + 1, 0
            size += 1
            out.append(scene)
        return rows.assign(scene=out)[["video", "i", "distance", "scene"]]

    return shots.select("video", "i", "distance").groupBy("video").applyInPandas(run, "video long, i long, distance double, scene long")


def smooth_levels(levels: DataFrame, attack: float, release: float) -> DataFrame:
    """levels(channel, i, level) with smooth: exponential smoothing, faster up (attack) than down (release)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        now, out = 0.0, []
        rows = rows.sort_values("i")
        for x in rows["level"]:
            now += (attack if x > now else release) * (x - now)
            out.append(now)
        return rows.assign(smooth=out)[["channel", "i", "level", "smooth"]]

    return levels.select("channel", "i", "level").groupBy("channel").applyInPandas(run, "channel long, i long, level double, smooth double")


def run_states(events: DataFrame, transitions: Mapping[tuple[str, str], str], start: str, terminal: set[str]) -> DataFrame:
    """(key, id, state) after each of events(key, id, at, event): unknown events and terminal states change nothing."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = start, []
        rows = rows.sort_values(["at", "id"])
        for e in rows["event"]:
            state = state if state in terminal else transitions.get((state, e), state)
            out.append(state)
        return rows.assign(state=out)[["key", "id", "state"]]

    return events.select("key", "id", "at", "event").groupBy("key").applyInPandas(run, "key long, id long, state string")


def scale_fleet(load: DataFrame, low: float, high: float, least: int, most: int) -> DataFrame:
    """(fleet, i, size): one more above high, one fewer under low, within bounds."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size, out = least, []
        rows = rows.sort_values("i")
        for x in rows["load"]:
            size = min(most, size + 1) if x > high else max(least, size - 1) if x < low else size
            out.append(size)
        return rows.assign(size=out)[["fleet", "i", "size"]]

    return load.select("fleet", "i", "load").groupBy("fleet").applyInPandas(run, "fleet long, i long, size long")


def locked_frequency(errors: DataFrame, nominal: float, gain: float) -> DataFrame:
    """errors(device, i, error) with frequency: nominal plus the sum of gain times the errors, held within a tenth of nominal at every step."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        away, most, out = 0.0, nominal * 0.1, []
        rows = rows.sort_values("i")
        for e in rows["error"]:
            away = max(-most, min(most, away + gain * e))
            out.append(nominal + away)
        return rows.assign(frequency=out)[["device", "i", "frequency"]]

    return errors.select("device", "i", "error").groupBy("device").applyInPandas(run, "device long, i long, frequency double")


def nearest_tour(points: DataFrame) -> DataFrame:
    """(path, id, place) of points(path, id, v): from the smallest id on, always to the nearest point left; ties go to the smaller id."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        v, order = np.array(rows["v"].tolist(), dtype=float), [0]
        met = np.zeros(len(rows), dtype=bool)
        for _ in range(len(rows) - 1):
            met[order[-1]] = True
            gap = ((v - v[order[-1]]) ** 2).sum(axis=1)
            order.append(int(np.where(met, np.inf, gap).argmin()))
        return pd.DataFrame({"path": rows["path"][0], "id": rows["id"][order].to_numpy(), "place": range(len(order))})

    return points.groupBy("path").applyInPandas(run, "path long, id long, place long")


def group_by_first(colours: DataFrame, within: float) -> DataFrame:
    """(set, id, cluster) of colours(set, id, r, g, b): a colour joins the first cluster whose first member is near in each channel."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, heads, out = rows.sort_values("id"), [], []
        for c in rows.itertuples():
            hit = next((i for i, h in enumerate(heads) if max(abs(c.r - h.r), abs(c.g - h.g), abs(c.b - h.b)) <= within), None)
            if hit is None:
                heads.append(c)
                hit = len(heads) - 1
            out.append(hit)
        return rows.assign(cluster=out)[["set", "id", "cluster"]]

    return colours.groupBy("set").applyInPandas(run, "set long, id long, cluster long")

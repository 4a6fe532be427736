"""The window operator by definition, on plain lists (test oracle only).

Nothing is processed step by step: the watermark a row sees is a maximum over the
rows before it, and every window's rows, class by class, and firing moment are
looked up in the whole input.
"""

from __future__ import annotations

LONG_MAX = 2**63 - 1


def windows_of(ts, size, slide, offset):
    """Starts of the windows [start, start + size) on the grid that contain ``ts``."""
    if ts - offset + slide > LONG_MAX:
        return []
    first = (ts - size - offset) // slide + 1
    starts = [offset + k * slide for k in range(first, (ts - offset) // slide + 1)]
    return [s for s in starts if s + size <= LONG_MAX]


def outcome(events, mode, bound, size, slide, offset, lateness, purge, side_output, flush=False):
    """events: ('e', seq, key, ts, v) and ('w', seq, wm) in arrival order.

    Returns (outputs, late, dropped): outputs are (key, out_ts, value, fire, trigger_seq).
    """
    rows = [e for e in events if e[0] == "e"]

    def watermark(key, upto):
        """After all events with a sequence number up to ``upto``; None: none yet."""
        if mode == "explicit":
            known = [e[2] for e in events if e[0] == "w" and e[1] <= upto]
        else:
            known = [e[3] - bound for e in rows if e[1] <= upto and (mode == "global" or e[2] == key)]
        return max(known, default=None)

    def passed(moment, wm):
        return wm is not None and min(moment, LONG_MAX) <= wm

    seen = {e[1]: watermark(e[2], e[1] - 1) for e in rows}
    by_window, homeless = {}, []
    for e in rows:
        last = {s: s + size - 1 for s in windows_of(e[3], size, slide, offset)}
        open_ones = {s: m for s, m in last.items() if not passed(m + lateness, seen[e[1]])}
        for s, m in open_ones.items():
            by_window.setdefault((e[2], s), []).append((e, passed(m, seen[e[1]])))
        if not open_ones and seen[e[1]] is not None and (e[3] + lateness + 2**63) % 2**64 - 2**63 <= seen[e[1]]:
            homeless.append((e[2], e[3]))

    outputs = []
    for (key, start), members in by_window.items():
        out_ts = start + size - 1
        on_time = [e for e, late in members if not late]
        if on_time:
            reached = [e[1] for e in events if passed(out_ts, watermark(key, e[1]))]
            if reached or flush:
                outputs.append((key, out_ts, sum(e[4] for e in on_time), "on_time", min(reached, default=None)))
        for e, late in members:
            if late:
                together = [e] if purge else [x for x, _ in members if x[1] <= e[1]]
                outputs.append((key, out_ts, sum(x[4] for x in together), "late", e[1]))
    return outputs, homeless if side_output else [], 0 if side_output else len(homeless)

"""Golden fixture cases (``FIXTURES.md`` format) as DataFrames.

A case lists its input in arrival order: ``key@ts`` is an element with v=1,
``W<n>`` an explicit watermark, ``|`` a snapshot/restore point (no effect in
batch). The arrival order becomes the explicit ``seq`` column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "seq BIGINT, k STRING, v INT, ts_ms BIGINT, wm BIGINT"


@dataclass
class Case:
    name: str
    cfg: dict[str, str]
    inputs: list[str]
    out: list[tuple[str, int, int]]
    late: list[tuple[str, int]]
    dropped: int
    restarts: list[int] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        out, seq = [], 0
        for tok in self.inputs:
            if tok == "|":
                continue
            if tok.startswith("W"):
                out.append((seq, None, None, None, int(tok[1:])))
            else:
                k, t = tok.split("@")
                out.append((seq, k, 1, int(t), None))
            seq += 1
        return out

    def segments(self) -> list[list[tuple]]:
        """Input rows cut at the snapshot/restore points."""
        segs, cur, seq = [], [], 0
        for tok in self.inputs:
            if tok == "|":
                segs.append(cur)
                cur = []
                continue
            if tok.startswith("W"):
                cur.append((seq, None, None, None, int(tok[1:])))
            else:
                k, t = tok.split("@")
                cur.append((seq, k, 1, int(t), None))
            seq += 1
        segs.append(cur)
        return segs

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)


def _pairs(text: str) -> list[str]:
    return [t for t in text.split() if t]


def parse_cases(markdown: str) -> list[Case]:
    cases = []
    for block in re.findall(r"```fixture\n(.*?)```", markdown, re.S):
        fields = {}
        for line in block.splitlines():
            if ":" in line and not line.startswith("#"):
                k, v = line.split(":", 1)
                fields[k.strip()] = v.strip()
        cfg = dict(kv.split("=") for kv in fields["cfg"].split())
        out = []
        for tok in _pairs(fields.get("out", "")):
            k, rest = tok.split("@")
            t, s = rest.split("=")
            out.append((k, int(t), int(s)))
        late = [(t.split("@")[0], int(t.split("@")[1])) for t in _pairs(fields.get("late", ""))]
        cases.append(Case(fields["name"], cfg, _pairs(fields["in"]), out, late, int(fields.get("dropped", "0"))))
    return cases

"""State space of the ancestry model and parsers of its text forms."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


def parse_states(expressions: Sequence[str], file: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """'AFR', 'ARC=NEA+DEN' or a name defined in ``file`` -> state name to populations, in order."""
    out: dict[str, list[str]] = {}
    for e in expressions:
        name, _, pops = e.partition("=")
        members = []
        for p in (pops or name).split("+"):
            p = p.strip()
            members += list((file or {}).get(p, [p]))
        out.setdefault(name.strip(), [])
        out[name.strip()] += [p for p in members if p not in out[name.strip()]]
    return out


def parse_chroms(text: str) -> list[str]:
    """'1-3,X' -> ['1', '2', '3', 'X']."""
    out: list[str] = []
    for part in text.split(","):
        lo, dash, hi = part.strip().partition("-")
        out += [str(i) for i in range(int(lo), int(hi) + 1)] if dash and lo.isdigit() and hi.isdigit() else [part.strip()] if part.strip() else []
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class StateSpace:
    """Homozygous, heterozygous and (optionally) inbred states over sources; X in males uses the haploid ones."""

    sources: tuple[str, ...]
    homo: tuple[str, ...] | None = None
    het: tuple[tuple[str, str], ...] | None = None
    inbred: bool = False
    names: tuple[str, ...] = field(init=False)
    pairs: tuple[tuple[int, int], ...] = field(init=False)

    def __post_init__(self) -> None:
        at = {s: i for i, s in enumerate(self.sources)}
        homo = self.sources if self.homo is None else self.homo
        het = tuple(itertools.combinations(self.sources, 2)) if self.het is None else self.het
        pairs = [(at[s], at[s]) for s in homo] + [(at[a], at[b]) for a, b in het]
        names = [*homo, *(a + b for a, b in het)]
        if self.inbred:
            pairs += [(at[s], -1) for s in homo]
            names += [f"h{s}" for s in homo]
        object.__setattr__(self, "names", tuple(names))
        object.__setattr__(self, "pairs", tuple(pairs))

    @property
    def n(self) -> int:
        return len(self.names)

    @property
    def n_homo(self) -> int:
        """Homozygous states, which come first; haploid chromosomes have only these."""
        return sum(a == b for a, b in self.pairs)

    def run_targets(self) -> list[tuple[str, str, list[str]]]:
        """(name, type, states whose posteriors add up): each het, each source in any form, each homo, each inbred."""
        kinds = {n: p for n, p in zip(self.names, self.pairs)}
        het = [(n, "het", [n]) for n, (a, b) in kinds.items() if a != b and b >= 0]
        state = [(s, "state", [n for n, p in kinds.items() if i in p]) for i, s in enumerate(self.sources)]
        homo = [(n, "homo", [n]) for n, (a, b) in kinds.items() if a == b]
        roh = [(n, "roh", [n]) for n, (_, b) in kinds.items() if b < 0]
        return het + state + homo + roh


def load_populations(path: str) -> dict[str, list[str]]:
    """A YAML file of population to samples (or panel columns)."""
    import yaml

    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    return {str(k): [str(x) for x in (v if isinstance(v, list) else [v])] for k, v in raw.get("sampleset", raw).items()}

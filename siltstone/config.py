"""What to index and how to search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame

TEXT, KEYWORD, URL = "text", "keyword", "url"
KINDS = (TEXT, KEYWORD, URL)

#: Feature types: whole token, token prefix, whole ASCII field, joined tokens, Han bigram, ASCII bigram.
EXACT, PREFIX, SIGNAL, JOIN, HAN, ASCII_GRAM = range(6)
SIGILS = {"e": EXACT, "p": PREFIX, "s": SIGNAL, "j": JOIN, "h": HAN, "g": ASCII_GRAM}

TAG_WEIGHT = 120.0
SCORE_CAP = 65535
#: A join feature is kept up to this many documents however small the corpus, and up to this share of it.
JOIN_DF_FLOOR, JOIN_DF_SHARE = 16, 0.08
FORMAT_VERSION = 1


def sigil_to_type(sigil: str) -> int:
    if sigil not in SIGILS:
        raise ValueError(f"unknown feature sigil {sigil!r}")
    return SIGILS[sigil]


@dataclass(frozen=True)
class FieldSpec:
    name: str
    weight: float
    kind: str = TEXT
    join_window: int = 3

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown field kind {self.kind!r}")


@dataclass(frozen=True)
class IndexConfig:
    """fields: FieldSpec rows, or name -> weight, or name -> FieldSpec arguments. Fields of no positive weight are dropped."""

    fields: Sequence[FieldSpec] | Mapping[str, float | Mapping]
    id_column: str = "id"
    order_by: Sequence[str] = ()
    store_fields: Sequence[str] | None = None
    signal_fields: Sequence[str] | None = None
    signal_max_length: int = 2048
    tags_field: str | None = None
    fuzzy: bool = True
    noise_df_cutoff: float = 0.4

    def resolved(self) -> IndexConfig:
        if not self.fields:
            raise ValueError("an index needs fields")
        if isinstance(self.fields, Mapping):
            specs = [FieldSpec(name, **x) if isinstance(x, Mapping) else FieldSpec(name, float(x)) for name, x in self.fields.items()]
        else:
            specs = list(self.fields)
        specs = [s for s in specs if s.weight > 0]
        if not specs:
            raise ValueError("an index needs a field of positive weight")
        stored = list(self.store_fields) if self.store_fields is not None else [s.name for s in specs]
        if self.signal_fields is not None:
            signal = [s.name for s in specs if s.name in self.signal_fields]
        else:
            signal = [s.name for s in specs if s.kind != URL] or [s.name for s in specs]
        return replace(self, fields=tuple(specs), store_fields=tuple(stored), signal_fields=tuple(signal), order_by=tuple(self.order_by) or (self.id_column,))

    @property
    def top_weight(self) -> float:
        return max(s.weight for s in self.fields)

    def as_dict(self) -> dict:
        return asdict(self) | {"fields": [asdict(s) for s in self.fields]}


@dataclass(frozen=True)
class SearchOptions:
    """keep: a condition on the hit columns, or a function that gives the hits to keep, applied after the candidates are ranked; rescore: a new score from the hit
    columns; prefilter: a condition on the documents (doc_ord, id, fields, tags), tested before ranking."""

    limit: int = 10
    min_score_ratio: float = 0.18
    keep: Column | Callable[[DataFrame], DataFrame] | None = None
    rescore: Column | Callable[[DataFrame], DataFrame] | None = None
    prefilter: Column | None = None
    highlight_fields: Sequence[str] | None = None
    highlight: bool = True

    @property
    def candidates(self) -> int:
        return max(3 * self.limit, 24)


@dataclass(frozen=True)
class SuggestOptions:
    limit: int = 8
    fuzzy: bool = True


@dataclass(frozen=True)
class HighlightOptions:
    tag: str = "mark"
    class_name: str | None = None
    open: str | None = None
    close: str | None = None
    extra: Mapping = field(default_factory=dict)

    def marks(self) -> tuple[str, str]:
        named = f' class="{self.class_name}"' if self.class_name else ""
        return (
            self.open if self.open is not None else f"<{self.tag}{named}>",
            self.close if self.close is not None else f"</{self.tag}>",
        )


def parse_field_spec(said: str) -> FieldSpec:
    """name:weight or name:kind:weight."""
    parts = [p.strip() for p in said.split(":")]
    try:
        if len(parts) == 2:
            return FieldSpec(parts[0], float(parts[1]))
        if len(parts) == 3:
            return FieldSpec(parts[0], float(parts[2]), parts[1])
    except ValueError as why:
        raise ValueError(f"bad field {said!r}: {why}") from None
    raise ValueError(f"bad field {said!r}: expected name:weight or name:kind:weight")

"""Tunables of retrieval. The defaults are fixed values that results depend on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # caps on hits of one specification: dense leg, result, rerank pool
    dense_cap: int = 5
    final_cap: int = 1
    rerank_cap: int = 4
    # pool sizes
    rerank_pool: int = 40
    candidates: int = 300
    oversample: int = 4
    oversample_max: int = 200
    # scores
    min_score: float = 0.15
    co_occurrence: float = 1.5
    rrf_k: int = 60
    study_discount: float = 0.5
    extras_discount: float = 0.5
    extras_neutral: float = 1.3
    release_match: float = 1.25
    release_mismatch: float = 0.85
    agreement_depth: int = 10
    # confidence
    high_margin: float = 0.12
    none_top: float = 0.25
    none_margin: float = 0.02
    # stubs, terms, study reports
    stub_chunks: int = 2
    stub_chars: int = 1500
    and_limit: int = 4
    digit_limit: int = 6
    short_term: int = 6
    short_terms: int = 4
    study_from: int = 700
    study_to: int = 1000
    # procedures and intents
    procedure_floor: float = 0.30
    procedure_relative: float = 0.45
    prefer_boost: float = 1.35
    intent_similarity: float = 0.50
    # sentences: picks, gap, lambda, window, characters
    brief: tuple = (4, 0.20, 0.7, 1, 350)
    normal: tuple = (6, 0.25, 0.7, 1, 600)
    sentence_floor: float = 0.20
    # shape of a text
    toc_hits: int = 3
    toc_multiplier: int = 2
    short_line: int = 60
    short_ratio: float = 0.7
    table_lines: int = 5
    # enumerations: which token, least bucket, least length, extra picks, relaxed floor
    enum_index: int = 1
    enum_bucket: int = 3
    enum_token: int = 2
    enum_extra: int = 3
    enum_picks: int = 8
    enum_least_picks: int = 5
    # replies
    score_floor: float = 0.10
    score_cut: float = 0.25
    batch: int = 20
    preview: int = 150
    guard_chars: int = 600
    guard_lines: int = 8
    # BM25
    k1: float = 1.2
    b: float = 0.75
    least_idf: float = 1e-6


DEFAULT = Settings()


def settings(conf: Mapping[str, str], prefix: str = "tessera.", base: Settings = DEFAULT) -> Settings:
    """Settings with the values that a mapping (os.environ, or dict(spark.sparkContext.getConf().getAll())) has for them under prefix + name; tuples are comma-separated."""
    found = {}
    for f in fields(Settings):
        if (text := conf.get(prefix + f.name)) is not None:
            old = getattr(base, f.name)
            found[f.name] = tuple(type(x)(float(v)) for x, v in zip(old, text.split(","), strict=True)) if isinstance(old, tuple) else type(old)(float(text))
    return replace(base, **found)

#: Fixed values that results depend on; sources.lexicons reads other lists from files.
STOP_WORDS = tuple(
    "what how does when where which who why explain describe tell list find show give resolve can could should would do is are was were "
    "the and for but not with this that from they will have has had been may might into onto over upon after before during since until while also then to of in on at by an or "
    "3gpp shall section clause table figure refer according following above below see per defined specified based used using given "
    "causing caused leads leading triggers triggered results occurs happens makes gets becomes "
    "nokia ericsson huawei samsung zte".split()
)
#: Fixed value: titles of study reports, as a pattern.
STUDY_TITLE = r"(?i)\b(?:study\s+(?:on|of|into)|feasibility\s+study|technical\s+report\b)"
#: Lead-ins of questions, as patterns.
LEAD_INS = (r"how\s+(?:to|do|does|can|should|would)", r"what\s+(?:is|are|does)", r"why\s+(?:is|are)", r"explain\s+", r"describe\s+", r"tell\s+me\s+(?:about|how)", r"find\s+", r"show\s+me\s+", r"give\s+me\s+")
#: Keys of request envelopes, and path elements that say nothing.
ENVELOPE_KEYS = ("query", "question", "q", "text", "prompt", "search")
PATH_NOISE = ("attributes", "configdata", "bulkcmconfigdatafile", "from", "then")
#: The series that own the parameters of a technology, and those of a vendor's own configuration model.
TECHNOLOGY_SERIES = {"lte": "36", "4g": "36", "eps": "36", "5g": "38", "nr": "38", "5gs": "38"}
VENDOR_SERIES = {"juniper": "JUNIPER", "cisco": "CISCO", "nokia": "NOKIA"}
#: The forms of valid filters.
FILTER_FORMS = {"release": r"(?i)^Rel-\d{1,2}$", "series": r"(?i)^(?:[0-9]{2}|[A-Z]|CISCO|JUNIPER|NOKIA|MIB|RFC|ETSI-NFV|ETSI NFV|ITU-T|ITU-T-G|GSMA|O-RAN|TM-Forum|MEF)$", "doc_type": r"(?i)^(?:TS|TR|REC|RFC|GS|SPEC|CLI|YANG)$"}

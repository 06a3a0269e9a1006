"""What each finding means and doesn't mean, in words for people and fields for programs."""

from __future__ import annotations

from dataclasses import dataclass

_COUNT, _RECORD, _COHORT = "findings[].affected_count", "findings[].evidence.records[].", "cohort_findings[].evidence.records[]."


@dataclass(frozen=True)
class Guidance:
    meaning: str
    why: str
    #: places in reports that show the finding
    evidence: tuple[str, ...]
    cannot_conclude: tuple[str, ...]
    #: what the suggested actions are about, and why they are suggested
    target: str
    reason: str


def _s(*names: str) -> tuple[str, ...]:
    return (*(f"summary.{n}" for n in names), _COUNT)


GUIDANCE = {
    "duplicate_ids": Guidance(
        "An id stands for more than one record.", "Indexes and joins by id then find one record and miss or mix up the others.", _s("duplicate_id_count"),
        ("that sequences are the same", "that the assembly is wrong"), "records that share an id", "Most tools take ids to be unique."),
    "duplicate_first_token_ids": Guidance(
        "Headers of several records begin with the same word.", "Many tools know a record by that word alone.", _s("duplicate_first_token_id_count"),
        ("that sequences are the same", "that any one validator would refuse the file"), "records whose headers begin alike", "Lookups by the first word may return another record."),
    "unsafe_ids": Guidance(
        "An id holds a slash, a control character or white space at an end.", "Such ids break file names, tables and some indexes.", _s("unsafe_id_count"),
        ("that a given database refuses the id",), "ids and headers", "Plain ids survive every format on the way."),
    "long_headers": Guidance(
        "A header is longer than 255 characters.", "Some formats cut headers or refuse them.", _s("long_header_count"),
        ("that a given database refuses the header",), "ids and headers", "Descriptions are safer in a table beside the file."),
    "reserved_header_chars": Guidance(
        "A header holds a character that tools use as a separator or quote.", "Parsers may split the header there.", _s("reserved_header_char_count"),
        ("that a given tool misreads the header",), "ids and headers", "Plain headers survive every format on the way."),
    "invalid_chars": Guidance(
        "A sequence holds symbols other than nucleotide codes.", "Aligners and indexers stop at them or guess.", _s("invalid_sequence_count"),
        ("what the symbols were meant to be",), "records with other symbols", "Symbols should be mended or recoded on purpose before they are used."),
    "high_n_rate": Guidance(
        "Many bases are unknown, in single records or over all.", "Unknown bases hide genes and lower mapping.", ("summary.n_percent", *_s("high_n_sequence_count"), "findings[].affected_fraction"),
        ("that the assembly is incomplete", "where the unknown bases come from"), "records with many unknown bases", "They show regions that are masked or not resolved."),
    "tiny_contigs": Guidance(
        "Records are shorter than the least length asked for.", "Short pieces add noise and are often refused.", _s("tiny_contig_count"),
        ("that the records are artefacts",), "short records", "They should be looked at before they are dropped."),
    "gap_runs": Guidance(
        "A run of unknown bases is longer than allowed.", "Long gaps break genes and upset scaffold checks.", _s("max_gap_run"),
        ("that scaffolds are joined wrongly", "the real length of the gap"), "scaffolds with long runs of N", "Gaps may need closing or a look at the join."),
    "terminal_ns": Guidance(
        "A record begins or ends with unknown bases.", "Archives ask for ends without them.", (*_s("terminal_n_sequence_count"), _RECORD + "signals"),
        ("that an archive refuses the file",), "records with N at an end", "Ends can often be trimmed without loss."),
    "gap_pattern_warnings": Guidance(
        "A run of unknown bases is exactly 100 long.", "This length is commonly written for gaps of unknown size.", (*_s("repeated_gap_pattern_sequence_count"), _RECORD + "signals"),
        ("that the gap is 100 bases long",), "records with runs of exactly 100 N", "Stand-ins should be known as such before annotation."),
    "expected_size_outlier": Guidance(
        "The bases without gaps are far from the expected size.", "Sequence may be missing, repeated or foreign, or the expectation wrong.", ("summary.ungapped_total_length", "profile.expected_size_bases", "profile.expected_size_tolerance"),
        ("contamination", "completeness"), "total length without gaps", "Size and expectation should be brought together first."),
    "duplicate_sequences": Guidance(
        "Several records have the same sequence.", "Repeats count twice in coverage and statistics.", _s("duplicate_sequence_count"),
        ("that a copy is wrong", "biological duplication"), "records with equal sequences", "Copies should be meant, or go."),
    "gc_outliers": Guidance(
        "GC content of a record is far from that of the sample.", "It may come from another organism or from an odd region.", (_COUNT, _RECORD + "gc_percent", _RECORD + "gc_zscore"),
        ("contamination", "the origin of the record"), "records with unusual GC", "Coverage and taxonomy tell odd regions from foreign ones."),
    "length_outliers": Guidance(
        "The length of a record is far from those of the sample.", "Joined, cut or foreign records stand out this way.", (_COUNT, _RECORD + "length", _RECORD + "gc_percent"),
        ("that the record is wrong",), "records of unusual length", "They should be looked at before they are filtered."),
    "composite_anomalies": Guidance(
        "A record shows several unusual signs at once.", "Such records are worth the first look.", (_COUNT, *(_RECORD + f for f in ("gc_percent", "n_fraction", "gc_zscore", "signals"))),
        ("contamination", "the cause of the signs"), "records with several signs", "Together the signs say more than each alone."),
    "invalid_fasta_structure": Guidance(
        "The file breaks the rules of FASTA.", "Readers stop, or read something else than was meant.", ("verdict.reasons", "findings[].message"),
        ("anything about the sequences",), "headers and records", "Each record needs a header and a sequence."),
    "cohort_total_length_outliers": Guidance(
        "The total length of a sample is far from the others.", "The sample may be mixed up, partial or contaminated.", ("cohort_findings[].affected_count", *(_COHORT + f for f in ("sample_id", "total_length", "reason"))),
        ("which of the samples is wrong",), "samples of unusual total length", "They should be looked at before the batch goes on."),
    "cohort_gc_outliers": Guidance(
        "GC content of a sample is far from the others.", "The sample may be mixed up or contaminated.", ("cohort_findings[].affected_count", *(_COHORT + f for f in ("sample_id", "gc_percent", "reason"))),
        ("contamination", "which of the samples is wrong"), "samples of unusual GC", "They should be looked at before the batch is interpreted."),
}

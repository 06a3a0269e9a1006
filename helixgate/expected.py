"""Expected values for the SQL that queries are held against, written out by hand.

Nothing here is derived from the engine's own tables, so that an entry changed there by mistake shows.
"""

# Readiness categories that each finding touches.
TOUCH = """
('invalid_fasta_structure', 'file'),
('invalid_fasta_structure', 'structure'),
('invalid_fasta_structure', 'submission'),
('invalid_chars', 'alphabet'),
('invalid_chars', 'submission'),
('duplicate_ids', 'index'),
('duplicate_ids', 'submission'),
('duplicate_first_token_ids', 'index'),
('duplicate_first_token_ids', 'submission'),
('unsafe_ids', 'index'),
('unsafe_ids', 'submission'),
('long_headers', 'index'),
('long_headers', 'submission'),
('reserved_header_chars', 'index'),
('reserved_header_chars', 'submission'),
('terminal_ns', 'assembly'),
('terminal_ns', 'submission'),
('gap_pattern_warnings', 'assembly'),
('gap_pattern_warnings', 'submission'),
('gap_runs', 'assembly'),
('gap_runs', 'submission'),
('high_n_rate', 'assembly'),
('high_n_rate', 'submission'),
('tiny_contigs', 'assembly'),
('tiny_contigs', 'submission'),
('gc_outliers', 'assembly'),
('length_outliers', 'assembly'),
('composite_anomalies', 'assembly'),
('expected_size_outlier', 'assembly'),
('duplicate_sequences', 'machine')
"""

# Readiness categories in order.
CATEGORIES = """
(0, 'file'),
(1, 'structure'),
(2, 'alphabet'),
(3, 'index'),
(4, 'assembly'),
(5, 'submission'),
(6, 'machine')
"""

# Routing hints as (finding, place, condition, route, needs an external database).
HINTS = """
('duplicate_ids', 0, 'duplication_issue', 'deduplicate_or_rename_records', false),
('duplicate_sequences', 0, 'duplication_issue', 'deduplicate_or_rename_records', false),
('duplicate_first_token_ids', 0, 'index_readiness_failure', 'rename_records_before_indexing', false),
('duplicate_first_token_ids', 1, 'submission_readiness_failure', 'fix_fasta_before_official_validation', false),
('unsafe_ids', 0, 'header_compatibility_warning', 'review_headers_before_database_or_submission', false),
('unsafe_ids', 1, 'submission_readiness_failure', 'fix_fasta_before_official_validation', false),
('long_headers', 0, 'header_compatibility_warning', 'review_headers_before_database_or_submission', false),
('long_headers', 1, 'submission_readiness_failure', 'fix_fasta_before_official_validation', false),
('reserved_header_chars', 0, 'header_compatibility_warning', 'review_headers_before_database_or_submission', false),
('reserved_header_chars', 1, 'submission_readiness_failure', 'fix_fasta_before_official_validation', false),
('invalid_chars', 0, 'validity_failure', 'repair_fasta_before_downstream_qc', false),
('invalid_fasta_structure', 0, 'validity_failure', 'repair_fasta_before_downstream_qc', false),
('high_n_rate', 0, 'assembly_ambiguity', 'gap_closing_or_polishing_review', false),
('gap_runs', 0, 'assembly_ambiguity', 'gap_closing_or_polishing_review', false),
('terminal_ns', 0, 'submission_readiness_warning', 'review_gap_and_terminal_n_patterns', false),
('gap_pattern_warnings', 0, 'submission_readiness_warning', 'review_gap_and_terminal_n_patterns', false),
('expected_size_outlier', 0, 'expected_size_warning', 'run_submission_or_contamination_followup', true),
('tiny_contigs', 0, 'small_record_review', 'review_or_filter_short_records', false),
('length_outliers', 0, 'length_outlier', 'record_length_review', false),
('gc_outliers', 0, 'composition_anomaly', 'contamination_or_cobiont_triage', true),
('composite_anomalies', 0, 'composition_anomaly', 'contamination_or_cobiont_triage', true)
"""

# Actions as (finding, place, action, tool, needs an external database).
ACTIONS = """
('duplicate_ids', 0, 'rename_records', 'seqkit', false),
('duplicate_first_token_ids', 0, 'rename_records', 'seqkit', false),
('unsafe_ids', 0, 'normalize_headers', 'seqkit', false),
('long_headers', 0, 'normalize_headers', 'seqkit', false),
('reserved_header_chars', 0, 'normalize_headers', 'seqkit', false),
('invalid_chars', 0, 'correct_symbols', 'seqkit', false),
('high_n_rate', 0, 'inspect_records', 'seqkit', false),
('high_n_rate', 1, 'run_assembly_qc', 'QUAST', false),
('tiny_contigs', 0, 'filter_or_review_records', 'seqkit', false),
('gap_runs', 0, 'inspect_gap_regions', 'QUAST', false),
('terminal_ns', 0, 'review_terminal_ns', 'seqkit', false),
('gap_pattern_warnings', 0, 'review_gap_patterns', 'QUAST', false),
('expected_size_outlier', 0, 'review_expected_size', 'NCBI expected genome size check', true),
('duplicate_sequences', 0, 'deduplicate_or_confirm', 'seqkit', false),
('gc_outliers', 0, 'inspect_records', 'BlobToolKit', true),
('gc_outliers', 1, 'compare_kmers_or_taxonomy', 'sourmash', true),
('length_outliers', 0, 'inspect_records', 'seqkit', false),
('composite_anomalies', 0, 'prioritize_records', 'BlobToolKit', true),
('invalid_fasta_structure', 0, 'repair_fasta_structure', 'parser-aware cleanup script', false)
"""

# Fixed values: (place, finding, severity, category, confidence, needs follow-up, first action).
CATALOG = """
(0, 'duplicate_ids', 'critical', 'duplication', 'high', false, 'rename_records'),
(1, 'duplicate_first_token_ids', 'critical', 'duplication', 'high', false, 'rename_records'),
(2, 'unsafe_ids', 'major', 'validity', 'moderate', false, 'normalize_headers'),
(3, 'long_headers', 'minor', 'validity', 'moderate', false, 'normalize_headers'),
(4, 'reserved_header_chars', 'minor', 'validity', 'moderate', false, 'normalize_headers'),
(5, 'invalid_chars', 'critical', 'validity', 'high', false, 'correct_symbols'),
(6, 'high_n_rate', 'major', 'composition', 'high', false, 'inspect_records'),
(7, 'tiny_contigs', 'minor', 'structure', 'moderate', false, 'filter_or_review_records'),
(8, 'gap_runs', 'major', 'structure', 'high', false, 'inspect_gap_regions'),
(9, 'terminal_ns', 'major', 'structure', 'moderate', false, 'review_terminal_ns'),
(10, 'gap_pattern_warnings', 'minor', 'structure', 'moderate', false, 'review_gap_patterns'),
(11, 'expected_size_outlier', 'major', 'structure', 'moderate', true, 'review_expected_size'),
(12, 'duplicate_sequences', 'minor', 'duplication', 'high', false, 'deduplicate_or_confirm'),
(13, 'gc_outliers', 'major', 'composition', 'moderate', true, 'inspect_records'),
(14, 'length_outliers', 'minor', 'structure', 'moderate', false, 'inspect_records'),
(15, 'composite_anomalies', 'major', 'composition', 'moderate', true, 'prioritize_records'),
(16, 'invalid_fasta_structure', 'critical', 'validity', 'high', false, 'repair_fasta_structure')
"""

# Findings on which gates fail, with two named by the user.
FAIL_ON = """
('none', '', 'gap_runs,tiny_contigs'),
('pipeline', '', 'duplicate_first_token_ids,duplicate_ids,gap_runs,high_n_rate,invalid_chars,invalid_fasta_structure,tiny_contigs'),
('submission', 'generic', 'duplicate_first_token_ids,duplicate_ids,gap_runs,invalid_chars,invalid_fasta_structure,tiny_contigs,unsafe_ids'),
('submission', 'ncbi', 'duplicate_first_token_ids,duplicate_ids,gap_runs,invalid_chars,invalid_fasta_structure,reserved_header_chars,tiny_contigs,unsafe_ids')
"""
PIPELINE = "'duplicate_first_token_ids', 'duplicate_ids', 'high_n_rate', 'invalid_chars', 'invalid_fasta_structure'"
NCBI = "'duplicate_first_token_ids', 'duplicate_ids', 'invalid_chars', 'invalid_fasta_structure', 'unsafe_ids', 'reserved_header_chars'"
NCBI_AND_N = NCBI + ", 'high_n_rate'"
VALIDATOR = "'duplicate_first_token_ids', 'unsafe_ids', 'long_headers', 'reserved_header_chars', 'terminal_ns', 'gap_pattern_warnings'"
SCREEN = "'high_n_rate', 'gap_runs'"
PASS_TOOLS = "QUAST,BUSCO,BlobToolKit"

# What the small FASTA files hold, read off them by hand.
FASTA = {
    "fasta_problems": """SELECT * FROM (VALUES
('stray', 2::BIGINT), ('header', 3), ('empty', 1), ('end', 3), ('none', 0)) t(sample_id, line)""",
    "fasta_records": """SELECT * FROM (VALUES
('dup', 0::BIGINT, 1::BIGINT, 'a', 5::INT, 10::INT), ('dup', 1, 3, 'a', 5, 10), ('dup', 2, 5, 'b/c', 3, 10), ('dup', 3, 7, 'd|e', 7, 10),
('bad', 0, 1, 'x', 1, 8), ('bad', 1, 4, 'y', 1, 10), ('bad', 2, 6, 'z', 1, 501),
('long', 0, 1, repeat('h', 256), 256, 240), ('long', 1, 3, 'g', 1, 580),
('lines', 0, 3, 'p', 7, 7), ('lines', 1, 7, 'q', 8, 4)) t(sample_id, record_idx, header_line, id, header_length, sequence_length)""",
    "fasta_flags": """SELECT * FROM (VALUES
('dup', 0::BIGINT, 'a', 10::BIGINT, false, false, false, false, false, false, 0::BIGINT, 0::BIGINT, 0::BIGINT),
('dup', 1, 'a', 10, true, true, false, false, false, false, 0, 0, 0),
('dup', 2, 'b/c', 10, false, false, true, true, false, false, 0, 0, 0),
('dup', 3, 'd|e', 10, false, false, false, false, false, true, 0, 2, 0),
('bad', 0, 'x', 8, false, false, false, false, false, false, 4, 0, 0),
('bad', 1, 'y', 10, false, false, false, false, false, false, 0, 10, 0),
('bad', 2, 'z', 501, false, false, false, false, false, false, 0, 101, 0),
('long', 0, repeat('h', 256), 240, false, false, false, false, true, false, 0, 0, 0),
('long', 1, 'g', 580, false, false, false, false, false, false, 0, 100, 1),
('lines', 0, 'p', 7, false, false, false, false, false, false, 1, 2, 0),
('lines', 1, 'q', 4, false, false, false, false, false, true, 0, 0, 0)) t(sample_id, record_idx, id, length, duplicate_id, duplicate_first_token_id,
duplicate_sequence, unsafe_id, long_header, reserved_header_chars, invalid_count, max_gap_run, gap_run_100_count)""",
    "fasta_findings": """SELECT * FROM (VALUES
('dup', 'duplicate_ids', 'critical', 1::BIGINT), ('dup', 'duplicate_first_token_ids', 'critical', 1), ('dup', 'unsafe_ids', 'major', 1),
('dup', 'reserved_header_chars', 'minor', 1), ('dup', 'high_n_rate', 'major', 1), ('dup', 'tiny_contigs', 'minor', 4), ('dup', 'duplicate_sequences', 'minor', 1),
('bad', 'invalid_chars', 'critical', 1), ('bad', 'high_n_rate', 'major', 2), ('bad', 'tiny_contigs', 'minor', 2), ('bad', 'gap_runs', 'major', 1),
('bad', 'terminal_ns', 'major', 1), ('bad', 'composite_anomalies', 'major', 1),
('long', 'long_headers', 'minor', 1), ('long', 'high_n_rate', 'major', 2), ('long', 'gap_pattern_warnings', 'minor', 1),
('lines', 'reserved_header_chars', 'minor', 1), ('lines', 'invalid_chars', 'critical', 1), ('lines', 'high_n_rate', 'major', 1),
('lines', 'tiny_contigs', 'minor', 2), ('lines', 'terminal_ns', 'major', 1), ('lines', 'composite_anomalies', 'major', 1)) t(sample_id, finding_id, severity, affected_count)""",
    "cohort_outliers_fixed": """SELECT * FROM (VALUES
('s5', 'cohort_total_length_outliers', 1000000e0), ('s6', 'cohort_gc_outliers', 80e0)) t(sample_id, finding_id, value)""",
}

_INT = lambda c: f"{c}::VARCHAR"
_DEC = lambda c: f"regexp_replace({c}::DECIMAL(38,2)::VARCHAR, '\\.?0+$', '')"
#: The 56 metrics of a sample's TSV as SQL text.
TSV = {
    "schema_version": "'0.5.0'", "profile": "'assembly'", "verdict": "status", "gate_mode": "'pipeline'", "gate_status": "status",
    "gate_blocking_findings": "blocking_findings", "gate_advisory_findings": "advisory_findings",
    "readiness_status": "CASE WHEN blockers <> '' THEN 'FAIL' ELSE status END", "readiness_blockers": "blockers",
    "readiness_file_status": "file_status", "readiness_structure_status": "structure_status", "readiness_alphabet_status": "alphabet_status", "readiness_index_status": "index_status",
    "readiness_assembly_status": "assembly_status", "readiness_submission_status": "submission_status", "readiness_machine_status": "machine_status",
    "submission_target": "NULL", "submission_status": "submission_status", "submission_blocking_findings": "sub_block", "submission_advisory_findings": "sub_rest",
    "unsafe_identifier_count": _INT("unsafe_id_count"), "long_identifier_count": _INT("long_header_count"), "submission_duplicate_first_token_id_count": _INT("duplicate_first_token_id_count"),
    "gap_like_n_run_count": _INT("gap_pattern_sequence_count"), "input_sha256": "''",
    "sequence_count": _INT("sequence_count"), "total_length": _INT("total_length"), "min_length": _INT("min_length"), "max_length": _INT("max_length"),
    "mean_length": _DEC("mean_length"), "median_length": _DEC("median_length"), "n50": _INT("n50"), "n90": _INT("n90"), "l50": _INT("l50"), "l90": _INT("l90"),
    "gc_percent": _DEC("gc_percent"), "at_percent": _DEC("at_percent"), "n_percent": _DEC("n_percent"), "ambiguity_percent": _DEC("ambiguity_percent"),
    "duplicate_id_count": _INT("duplicate_id_count"), "duplicate_first_token_id_count": _INT("duplicate_first_token_id_count"), "duplicate_sequence_count": _INT("duplicate_sequence_count"),
    "unsafe_id_count": _INT("unsafe_id_count"), "long_header_count": _INT("long_header_count"), "reserved_header_char_count": _INT("reserved_header_char_count"),
    "invalid_sequence_count": _INT("invalid_sequence_count"), "high_n_sequence_count": _INT("high_n_sequence_count"), "tiny_contig_count": _INT("tiny_contig_count"),
    "terminal_n_sequence_count": _INT("terminal_n_sequence_count"), "repeated_gap_pattern_sequence_count": _INT("gap_pattern_sequence_count"), "max_gap_run": _INT("max_gap_run"),
    "ungapped_total_length": _INT("ungapped_total_length"), "gc_outlier_count": _INT("gc_outlier_count"), "length_outlier_count": _INT("length_outlier_count"),
    "composite_anomaly_count": _INT("composite_anomaly_count"), "finding_count": _INT("finding_count"),
}

"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from .queries import FOUR, LEGACY, THREE, TWO


def kept(letters: str) -> str:
    return f"regexp_replace(coalesce(text, ''), '[^{letters}]', '', 'g')"


MIXED = f"CASE doc_id % 3 WHEN 0 THEN {kept(TWO)} WHEN 1 THEN {kept(THREE)} ELSE {kept(FOUR)} END"
NAME = "'doc' || doc_id || ' ' || coalesce(lang, 'none')"
ENC = "CASE WHEN regexp_matches(s, '[RYSWKMBDHVNryswkmbdhvn-]') THEN '4b' WHEN regexp_matches(s, '[a-z]') THEN '3b' ELSE '2b' END"
NUC = "CASE WHEN regexp_matches(s, '[uU]') THEN 'RNA' ELSE 'DNA' END"
BYTES = "CAST(ceil(length(s) * CASE enc WHEN '2b' THEN 2 WHEN '3b' THEN 3 ELSE 4 END / 8.0) AS BIGINT)"
#: A sequence as it comes back: one of T and U is kept.
BACK = "CASE WHEN regexp_matches(s, '[uU]') THEN translate(s, 'Tt', 'Uu') ELSE s END"
RUNS = "len(regexp_extract_all(s, '[a-z]+'))"
RECORD_BYTES = f"(20 + octet_length(encode(description)) + {BYTES} + CASE WHEN enc = '4b' AND {RUNS} > 0 THEN 5 + 8 * {RUNS} ELSE 0 END)"


def derived(sequence: str = MIXED) -> str:
    return f"d AS (SELECT doc_id, lang, source, {NAME} AS description, {sequence} AS s FROM documents), e AS (SELECT *, {ENC} AS enc, {NUC} AS nuc FROM d)"


def pairs(digits: str, each: int, value: str, width: int, fill: int) -> str:
    """Digits in groups as hexadecimal ones, filled up with zeros to a multiple of ``fill``."""
    return f"array_to_string(list_transform(regexp_extract_all({digits} || repeat('0', (({fill} - length(s) % {fill}) % {fill})::INT), '{'.' * each}'), lambda x: format('{{:0{width}X}}', {value})), '')"


def value(base: int, n: int) -> str:
    # no number where the digits are of another encoding, which the caller leaves out
    return " + ".join(f"{base ** (n - 1 - k)} * TRY_CAST(x[{k + 1}] AS INT)" for k in range(n))


DIGITS_2B = "translate(s, 'TUCAG', '00123')"
DIGITS_3B = "translate(s, 'TUCAGtucag', '0012344567')"
HEX_2B = f"left({pairs(DIGITS_2B, 4, value(4, 4), 2, 4)}, 2 * CAST(ceil(length(s) / 4.0) AS INT))"
HEX_3B = f"left({pairs(DIGITS_3B, 4, value(8, 4), 3, 8)}, 2 * CAST(ceil(3 * length(s) / 8.0) AS INT))"
HEX_4B = "translate(upper(s), 'UTACGRYKMSWBDHVN-', '44821965A3C7DEBF0') || CASE WHEN length(s) % 2 = 1 THEN '0' ELSE '' END"
HEX_V1 = "translate(upper(s), 'UTACGRYKMSWBDHVN ', '44821965A3C7DEBF0')"


def packed(letters: str, expression: str) -> str:
    return f"WITH {derived(kept(letters))} SELECT doc_id, CAST(length(s) AS BIGINT) AS n_bases, {expression} AS packed FROM d"


def le32(n: str) -> str:
    h = f"format('{{:08X}}', CAST({n} AS BIGINT))"
    return f"substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2)"


RUN_ROWS = """r AS (
  SELECT doc_id, unnest(range(1, len(gaps) + 1)) AS i, gaps, lows FROM (
    SELECT doc_id, regexp_extract_all(s, '([^a-z]*)([a-z]+)', 1) AS gaps, regexp_extract_all(s, '([^a-z]*)([a-z]+)', 2) AS lows FROM e
  )
), runs AS (
  SELECT doc_id, i - 1 AS run_no, length(lows[i]) AS len,
    sum(length(gaps[i]) + length(lows[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(lows[i]) AS start FROM r
)"""

DAMAGED = f"""d AS (
  SELECT doc_id AS rec_no, coalesce(lang, '') || '|' || coalesce(source, '') || '|' || (doc_id % 50) AS description, {kept(THREE)} AS s FROM documents
), f AS (
  SELECT rec_no, CASE WHEN rec_no % 97 = 0 THEN 'nowhere' ELSE description END AS description,
    CASE WHEN rec_no % 7 = 0 THEN substr(s, 2) WHEN rec_no % 11 = 0 THEN replace(s, 'U', 'T') ELSE s END AS s FROM d
), last AS (SELECT description, arg_max(s, rec_no) AS o FROM d GROUP BY description),
known AS (SELECT DISTINCT s, true AS known FROM d), paired AS (SELECT DISTINCT description, s, true AS paired FROM d),
c AS (
  SELECT f.*, o, coalesce(known, false) AS known, coalesce(paired, false) AS paired FROM f LEFT JOIN last USING (description)
  LEFT JOIN known USING (s) LEFT JOIN paired ON paired.description = f.description AND paired.s = f.s
)"""


def marker_at(name: str) -> str:
    bits = f"{int({'DNA': '0F0', 'RNA': 'F0F', 'NEXT': '00F'}[name], 16):012b}" * 3
    return f"instr(bits, '{bits}')"


SQL = {
    "encoding_histogram": f"""WITH {derived()}, k AS (SELECT unnest(['2b', '3b', '4b']) AS enc)
SELECT k.enc, CAST(count(e.enc) AS BIGINT) AS records, CAST(coalesce(sum(length(s)), 0) AS BIGINT) AS bases, CAST(coalesce(sum({BYTES.replace("enc", "k.enc")}), 0) AS BIGINT) AS packed_bytes,
  CAST(sum(length(s)) AS DOUBLE) / nullif(CAST(sum({BYTES.replace("enc", "k.enc")}) AS DOUBLE), 0) AS bases_per_byte FROM k LEFT JOIN e ON e.enc = k.enc GROUP BY k.enc""",
    "alphabet_violations": "SELECT doc_id, nullif(regexp_extract(replace(coalesce(text, ''), chr(10), ''), '([^ATUCGatucgRYSWKMBDHVNryswkmbdhvn -])', 1), '') AS bad_symbol FROM documents",
    "pack_2b": packed(TWO, HEX_2B), "pack_3b": packed(THREE, HEX_3B), "pack_4b": packed(FOUR, HEX_4B),
    "unpack_roundtrip": f"WITH {derived()} SELECT doc_id, enc, {BACK} AS sequence FROM e",
    "softmask_runs": f"WITH {derived(kept(FOUR))}, {RUN_ROWS} SELECT doc_id, CAST(run_no AS BIGINT) AS run_no, CAST(start AS BIGINT) AS start, CAST(len AS BIGINT) AS len FROM runs",
    "softmask_apply": f"SELECT doc_id, {kept(FOUR)} AS sequence FROM documents",
    "nuc_type": f"""WITH {derived()} SELECT doc_id, CASE WHEN contains(s, 'U') THEN 'R' ELSE 'D' END AS tag, nuc AS inferred,
  CASE lang WHEN 'de' THEN 'RNA' WHEN 'fr' THEN 'DNA' ELSE nuc END AS decided FROM e""",
    "mixed_tu": f"""WITH {derived(kept(FOUR))}, m AS (SELECT doc_id AS rec_no, description FROM d WHERE contains(upper(s), 'T') AND contains(upper(s), 'U'))
SELECT rec_no, CASE WHEN length(description) > 200 THEN left(description, 200) || '…' ELSE description END AS description, (SELECT count(*) FROM m) AS n_mixed FROM m ORDER BY rec_no LIMIT 10""",
    "v1_record_hex": f"""WITH {derived(kept(LEGACY))} SELECT doc_id, hex(encode(description)) || CASE WHEN contains(upper(s), 'U') THEN 'F0F' ELSE '0F0' END || {HEX_V1} || '00F' AS record FROM d""",
    "v1_decode": f"WITH {derived(kept(TWO))} SELECT doc_id, description, s AS sequence, 'DNA' AS nuc FROM d",
    "v1_marker_guard": f"""WITH d AS (
  SELECT doc_id, {kept('ACGTN ')} || CASE doc_id % 3 WHEN 0 THEN 'A N  N  N ' WHEN 1 THEN 'N NN NN N' ELSE '' END AS s FROM documents
), b AS (
  SELECT doc_id, array_to_string(list_transform(regexp_extract_all({HEX_V1}, '.'), lambda x: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * CAST('0x' || x AS INT) + 1, 4)), '') AS bits FROM d
)
SELECT doc_id, CASE WHEN {marker_at('DNA')} > 0 THEN 'DNA' WHEN {marker_at('RNA')} > 0 THEN 'RNA' WHEN {marker_at('NEXT')} > 0 THEN 'NEXT' END AS marker,
  CAST(CASE WHEN {marker_at('DNA')} > 0 THEN {marker_at('DNA')} - 1 WHEN {marker_at('RNA')} > 0 THEN {marker_at('RNA')} - 1 WHEN {marker_at('NEXT')} > 0 THEN {marker_at('NEXT')} - 1 ELSE -1 END AS BIGINT) AS bit FROM b""",
    "v2_record_body": f"""WITH {derived()}, {RUN_ROWS}, b AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg({le32('start')} || {le32('len')}, '' ORDER BY run_no) AS bytes FROM runs GROUP BY doc_id
)
SELECT doc_id, '01' || {le32('octet_length(encode(description))')} || hex(encode(description)) || '02' || {le32('1')} || CASE nuc WHEN 'RNA' THEN '52' ELSE '44' END
  || CASE enc WHEN '2b' THEN '06' WHEN '3b' THEN '07' ELSE '03' END || {le32('length(s)')}
  || CASE enc WHEN '2b' THEN {HEX_2B} WHEN '3b' THEN {HEX_3B} ELSE {HEX_4B} END
  || CASE WHEN enc = '4b' AND n > 0 THEN '05' || {le32('8 * n')} || bytes ELSE '' END AS body FROM e LEFT JOIN b USING (doc_id)""",
    "container_size": f"""WITH {derived()} SELECT count(*) AS records, CAST(coalesce(sum(length(s)), 0) AS BIGINT) AS total_bp,
  CAST(12 + coalesce(sum({RECORD_BYTES}), 0) AS BIGINT) AS container_bytes FROM e""",
    "integrity_summary": f"""WITH {DAMAGED}, n AS (
  SELECT count(*) FILTER (s IS DISTINCT FROM o) AS mismatches, count(*) FILTER (NOT known) AS not_found, count(*) FILTER (known AND NOT paired) AS pair_mismatches,
    count(*) FILTER (o IS NOT NULL AND length(o) <> length(s)) AS length_mismatches, count(*) FILTER (o IS NOT NULL AND sha256(o) <> sha256(s)) AS hash_mismatches,
    (SELECT count(*) FROM d WHERE description NOT IN (SELECT description FROM f)) AS missing, (SELECT count(*) FROM d) AS originals, count(*) AS decoded FROM c
) SELECT *, greatest(mismatches, not_found, pair_mismatches, length_mismatches, hash_mismatches, missing) > 0 AS any_issue FROM n""",
    "integrity_details": f"""WITH {DAMAGED}, x AS (
  SELECT *, coalesce(o, '') AS a, coalesce(list_position(list_transform(list_zip(string_split(coalesce(o, ''), ''), string_split(s, '')), lambda z: z[1] IS DISTINCT FROM z[2]), true), 0) - 1 AS i
  FROM c WHERE s IS DISTINCT FROM o
), y AS (SELECT *, greatest(i - 20, 0) AS b, greatest(least(length(s), i + 20) - greatest(i - 20, 0), 0) AS n FROM x)
SELECT CAST(rec_no AS BIGINT) AS index, description,
  CASE WHEN o IS NULL THEN 'desc-missing-in-original' WHEN length(o) <> length(s) THEN 'length-mismatch'
    WHEN replace(o, 'U', 'T') = replace(s, 'U', 'T') AND contains(o, 'U') AND contains(o, 'T') THEN 'mixed-T/U-in-original (lossy 0x4 nibble)'
    WHEN replace(o, 'U', 'T') = replace(s, 'U', 'T') THEN 'global-T↔U-normalization' ELSE 'base-content-mismatch' END AS reason,
  CAST(i AS INTEGER) AS first_diff_at, CAST(length(a) - length(replace(a, 'T', '')) AS INTEGER) AS "orig_T", CAST(length(a) - length(replace(a, 'U', '')) AS INTEGER) AS "orig_U",
  CAST(length(s) - length(replace(s, 'T', '')) AS INTEGER) AS "dec_T", CAST(length(s) - length(replace(s, 'U', '')) AS INTEGER) AS "dec_U",
  CASE WHEN i < 0 THEN '' ELSE substr(a, b + 1, n) END AS ctx_orig, CASE WHEN i < 0 THEN '' ELSE substr(s, b + 1, n) END AS ctx_dec FROM y""",
    "sequence_names": f"WITH {DAMAGED} SELECT DISTINCT sha256(s) AS sha, description FROM d",
    "last_of_each": f"WITH {DAMAGED} SELECT description, sha256(o) AS sha FROM last",
    "sha256_sequences": f"SELECT doc_id, sha256({kept(THREE)}) AS sha FROM documents",
    "total_bp": f"WITH {derived()} SELECT CAST(coalesce(sum(length(s)), 0) AS BIGINT) AS total_bp FROM d",
    "ncf_by_lang": f"""WITH {derived()} SELECT coalesce(lang, 'none') AS lang, CAST(sum(length(s)) AS BIGINT) AS total_bp, CAST(sum({BYTES}) AS BIGINT) AS packed_bytes,
  CAST(sum(length(s)) AS DOUBLE) / nullif(CAST(sum({BYTES}) AS DOUBLE), 0) AS bases_per_byte FROM e GROUP BY coalesce(lang, 'none')""",
    "edit_text_render": f"""WITH {derived()} SELECT doc_id, '>' || description || ' | NUC=' || nuc || ' | ENC=' || enc || CASE WHEN s = '' THEN '' ELSE chr(10) || array_to_string(regexp_extract_all(s, '.{{1,80}}'), chr(10)) END AS rendered FROM e""",
    "edit_text_parse": f"WITH {derived()} SELECT doc_id, CAST(1 AS BIGINT) AS rec_no, description, s AS sequence, nuc AS nuc_hint, CASE WHEN s = '' THEN 'Record has no sequence' END AS problem FROM e",
    "edit_text_blocks": f"""WITH {derived()}, r AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS rec_no, description, s AS sequence, nuc AS nuc_hint, false AS stray FROM e
  UNION ALL SELECT doc_id, 2, description || ' again', CASE WHEN doc_id % 7 = 0 THEN 'ACGT' ELSE '' END || s, 'RNA', doc_id % 7 = 0 FROM e
) SELECT doc_id, rec_no, description, sequence, nuc_hint, CASE WHEN stray THEN 'Sequence outside of a record' WHEN sequence = '' THEN 'Record has no sequence' END AS problem FROM r""",
    "record_violations": f"""WITH {derived(kept('QZ-'))} SELECT doc_id AS rec_no, CASE WHEN s = '' THEN 'empty sequence' ELSE 'unknown type' END AS reason FROM d WHERE s = '' OR doc_id % 13 = 0""",
    "fasta_roundtrip": f"WITH {derived()} SELECT string_split(description, ' ')[1] AS id, description, s AS sequence FROM d",
    "container_roundtrip": f"WITH {derived()} SELECT description, {BACK} AS sequence, nuc FROM e",
    "container_chunks": f"""WITH {derived()}, b AS (SELECT doc_id, {BACK} AS t, nuc, unnest(range(0, greatest(length(s), 1), 1000)) AS start FROM e)
SELECT doc_id, start // 1000 AS chunk_no, start, CAST(length(substr(t, start + 1, 1000)) AS BIGINT) AS n, nuc, substr(t, start + 1, 1000) AS symbols FROM b""",
    "container_sql": f"""WITH {derived()}, b AS (SELECT description, {BACK} AS s, enc, nuc, {RECORD_BYTES} AS record_bytes FROM e)
SELECT description, s AS sequence, nuc, enc, CAST(record_bytes AS INTEGER) AS record_bytes FROM b""",
    "legacy_roundtrip": f"""WITH {derived(kept(LEGACY))} SELECT description, CASE WHEN contains(upper(s), 'U') THEN replace(upper(s), 'T', 'U') ELSE upper(s) END AS sequence,
  CASE WHEN contains(upper(s), 'U') THEN 'RNA' ELSE 'DNA' END AS nuc FROM d""",
    "convert_and_verify": f"""WITH {derived(kept(FOUR))}, b AS (SELECT description, s, {BACK} AS t FROM e), n AS (
  SELECT count(*) FILTER (t <> s) AS mismatches, count(*) FILTER (t NOT IN (SELECT s FROM d)) AS not_found, count(*) FILTER (t <> s AND t IN (SELECT s FROM d)) AS pair_mismatches,
    count(*) FILTER (length(t) <> length(s)) AS length_mismatches, count(*) FILTER (sha256(t) <> sha256(s)) AS hash_mismatches,
    (SELECT count(*) FROM d WHERE description NOT IN (SELECT description FROM b)) AS missing, (SELECT count(*) FROM documents) AS originals, count(*) AS decoded, count(*) AS written,
    count(*) FILTER (contains(upper(s), 'T') AND contains(upper(s), 'U')) AS mixed FROM b
) SELECT *, greatest(mismatches, not_found, pair_mismatches, length_mismatches, hash_mismatches, missing) > 0 AS any_issue FROM n""",
    "edit_text_roundtrip": f"WITH {derived()} SELECT description, s AS sequence, nuc, CASE WHEN s = '' THEN 'Record has no sequence' END AS problem FROM e",
    "save_roundtrip": f"WITH {derived()} SELECT description, {BACK} AS sequence, nuc FROM e WHERE s <> ''",
    "compressed_roundtrip": f"WITH {derived()} SELECT description, s AS sequence FROM d",
    "encoded_stream": f"""WITH {derived()} SELECT description, enc, CAST(NULL AS VARCHAR) AS bad_symbol, CAST(length(s) AS BIGINT) AS n_bases, CAST({RECORD_BYTES} AS BIGINT) AS record_bytes FROM e""",
    "file_sizes": f"""WITH {derived()}, n AS (SELECT CAST(coalesce(sum({RECORD_BYTES}), 0) AS BIGINT) AS n FROM e) SELECT n AS size_bytes, n AS written FROM n""",
    "plain_sizes": f"""WITH {derived()}, n AS (
  SELECT CAST(coalesce(sum(octet_length(encode(description)) + 2 + length(s) + greatest(ceil(length(s) / 80.0), 1)), 0) AS BIGINT) AS fasta, CAST(12 + coalesce(sum({RECORD_BYTES}), 0) AS BIGINT) AS container, sum(length(s)) AS total FROM e
), m AS (SELECT 'fasta' AS method, fasta AS size_bytes, total FROM n UNION ALL SELECT 'container', container, total FROM n), r AS (SELECT method, size_bytes, round_even(total / size_bytes, 2) AS ncf FROM m)
SELECT method, size_bytes, ncf, format('{{:,}}', size_bytes) || ' B<br>NCF: ' || printf('%.2f', ncf) AS label FROM r""",
    "v1_decode_types": f"""WITH d AS (SELECT doc_id, {NAME} AS description, upper(CASE doc_id % 2 WHEN 0 THEN {kept('ACGTNRacgtnr')} ELSE {kept('ACGUNRacgunr')} END) AS s FROM documents)
SELECT doc_id, description, s AS sequence, CASE WHEN contains(s, 'U') THEN 'RNA' ELSE 'DNA' END AS nuc FROM d""",
    "shortened": f"""WITH d AS (SELECT doc_id, repeat({NAME}, CAST(doc_id % 60 AS INT)) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 200 THEN left(s, 200) || '…' ELSE s END AS description FROM d""",
    "output_names": """SELECT doc_id, 'x.seqs/doc' || doc_id || '.seqs' AS container,
  'x.fasta/doc' || doc_id || '.fasta' || CASE doc_id % 3 WHEN 0 THEN '_pigz.gz' WHEN 1 THEN '_zlib.gz' ELSE '.bz2' END AS compressed FROM documents""",
}
SQL["container_by_blocks"] = SQL["container_by_search"] = SQL["container_table_function"] = SQL["container_roundtrip"]
SQL["integrity_chunks"], SQL["integrity_chunks_summary"] = SQL["integrity_details"], SQL["integrity_summary"]
SQL["integrity_report"] = SQL["integrity_details"] + " ORDER BY index LIMIT 10"
#: The checksum's table, by its rule from the reversed polynomial.
CRC_TABLE = "SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)"
SQL["v2_record_crc"] = f"""WITH body AS ({SQL["v2_record_body"]}), crc_table AS ({CRC_TABLE}), bytes AS (
  SELECT doc_id, t, [4294967295] || list_transform(regexp_extract_all(body, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM body, crc_table
)
SELECT doc_id, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc, CAST(len(b) - 1 + 4 AS BIGINT) AS record_bytes FROM bytes"""
SQL["chunked_records"], SQL["chunked_runs"] = SQL["v2_record_crc"], SQL["softmask_runs"]
SQL["edit_text_encode"] = SQL["v2_record_crc"]
SQL["convert_long_and_verify"] = SQL["convert_and_verify"]

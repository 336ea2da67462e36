"""Registered queries over sequences derived from ``documents``, and the same in DuckDB SQL.

Sequences are the letters of a text that belong to an alphabet, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases, wire
from ..operators import chunk_scan, chunks, convert, digests, integrity, sizes
from ..sources import commits, compressed, container, edit_text, fasta, surface
from ..sources.scratch import scratch
from ..streaming import encode

TWO, THREE, FOUR = "ACGT", "ACGTUacgtu", "ACGTURYSWKMBDHVNacgturyswkmbdhvn-"
LEGACY = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept(letters: str) -> Column:
    """Of the text, the letters of an alphabet."""
    return F.regexp_replace(F.coalesce("text", F.lit("")), f"[^{letters}]", "")


def mixed() -> Column:
    """Sequences of all three encodings: the alphabet goes by the id."""
    turn = F.pmod("doc_id", F.lit(3))
    return F.when(turn == 0, kept(TWO)).when(turn == 1, kept(THREE)).otherwise(kept(FOUR))


def described() -> Column:
    return F.concat(F.lit("doc"), "doc_id", F.lit(" "), F.coalesce("lang", F.lit("none")))


def records(spark: SparkSession, sf_dir: str, sequence: Column | None = None) -> DataFrame:
    """doc_id, file, rec_no, description, sequence, nuc."""
    rows = documents(spark, sf_dir).select("doc_id", F.lit("docs").alias("file"), F.col("doc_id").alias("rec_no"), described().alias("description"), "lang", "source", (mixed() if sequence is None else sequence).alias("sequence"))
    return rows.withColumn("nuc", bases.nucleotide(F.col("sequence")))


def seq() -> Column:
    return F.col("sequence")


def encoding_histogram(spark, sf_dir):
    return sizes.encoding_histogram(records(spark, sf_dir))


def alphabet_violations(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", bases.bad_symbol(F.col("text")).alias("bad_symbol"))


def packed(letters: str, pack):
    def query(spark, sf_dir):
        return records(spark, sf_dir, kept(letters)).select("doc_id", bases.n_bases(seq()).alias("n_bases"), F.hex(pack(seq())).alias("packed"))

    return query


def unpack_roundtrip(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("enc", bases.encoding(seq()))
    rows = rows.select("doc_id", "enc", bases.pack(seq(), F.col("enc")).alias("payload"), bases.n_bases(seq()).alias("n_bases"), F.when(F.col("enc") == "4b", bases.case_runs(seq())).alias("runs"), bases.type_tag(seq(), F.col("nuc")).alias("tag"))
    return rows.select("doc_id", "enc", bases.unpack(F.col("payload"), F.col("n_bases"), F.col("enc"), F.col("tag"), F.col("runs")).alias("sequence"))


def softmask_runs(spark, sf_dir):
    rows = records(spark, sf_dir, kept(FOUR)).select("doc_id", F.posexplode(bases.case_runs(seq())).alias("run_no", "r"))
    return rows.select("doc_id", F.col("run_no").cast("long").alias("run_no"), F.col("r.start").cast("long").alias("start"), F.col("r.len").cast("long").alias("len"))


def softmask_apply(spark, sf_dir):
    rows = records(spark, sf_dir, kept(FOUR))
    return rows.select("doc_id", bases.with_case(bases.upper(seq()), bases.case_runs(seq())).alias("sequence"))


def nuc_type(spark, sf_dir):
    rows = records(spark, sf_dir)
    hint = F.when(F.col("lang") == "de", "rna").when(F.col("lang") == "fr", "DNA").otherwise(F.col("lang"))
    return rows.select("doc_id", bases.type_tag(seq(), F.lit("DNA")).alias("tag"), bases.nucleotide(seq()).alias("inferred"), bases.nucleotide(seq(), hint).alias("decided"))


def mixed_tu(spark, sf_dir):
    """The report of the first ten records that mix T and U, with how many there are."""
    path = scratch(spark, "mixed")
    convert.mixed_records(records(spark, sf_dir, kept(FOUR))).write.parquet(path)  # sequences are read once
    rows = spark.read.schema("file string, rec_no long, description string").parquet(path)
    first = rows.orderBy("rec_no").limit(10)
    return first.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n_mixed")))).select("rec_no", "description", "n_mixed")  # one row


def v1_record_hex(spark, sf_dir):
    return records(spark, sf_dir, kept(LEGACY)).select("doc_id", wire.legacy_record(F.col("description"), seq(), any_bit=False).alias("record"))


def v1_decode(spark, sf_dir):
    rows = records(spark, sf_dir, kept(TWO))
    return rows.select("doc_id", wire.legacy_decoded(wire.legacy_record(F.col("description"), seq())).alias("r")).select("doc_id", "r.*")


def v1_decode_types(spark, sf_dir):
    """DNA and RNA with degenerate codes; records end at any half byte."""
    rows = records(spark, sf_dir, F.when(F.pmod("doc_id", F.lit(2)) == 0, kept("ACGTNRacgtnr")).otherwise(kept("ACGUNRacgunr")))
    return rows.select("doc_id", wire.legacy_decoded(wire.legacy_record(F.col("description"), seq())).alias("r")).select("doc_id", "r.*")


def shortened(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", bases.shortened(F.repeat(F.col("description"), F.pmod("doc_id", F.lit(60)).cast("int"))).alias("description"))


def v1_marker_guard(spark, sf_dir):
    planted = F.when(F.pmod("doc_id", F.lit(3)) == 0, "A N  N  N ").when(F.pmod("doc_id", F.lit(3)) == 1, "N NN NN N").otherwise("")
    rows = documents(spark, sf_dir).select("doc_id", F.concat(kept("ACGTN "), planted).alias("sequence"))
    return rows.select("doc_id", wire.marker_hits(wire.legacy_digits(seq())).alias("h")).select("doc_id", "h.marker", F.coalesce(F.col("h.bit"), F.lit(-1)).cast("long").alias("bit"))


def v2_record_body(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", F.hex(wire.record_body(F.col("description"), seq(), F.col("nuc"))).alias("body"))


def v2_record_crc(spark, sf_dir):
    facts = lambda body: F.struct(F.crc32(body).alias("crc"), (F.octet_length(body) + 4).cast("long").alias("record_bytes"))
    body = wire.record_body(F.col("description"), seq(), F.col("nuc"))
    return records(spark, sf_dir).select("doc_id", bases.let(body, facts).alias("f")).select("doc_id", "f.*")


def chunked_records(spark, sf_dir):
    """Records by chunks of FASTA lines: their checksums are put together from those of parts."""
    path = scratch(spark, "chunked")
    fasta.write_fasta(records(spark, sf_dir), path)
    rows = chunks.read_fasta_chunks(spark, path, size=1000)
    named = rows.groupBy("file", "rec_no").agg(F.max("description").alias("description"))
    doc_id = F.regexp_extract("description", "^doc([0-9]+)", 1).cast("long")
    return chunks.checksums(chunks.parts(rows)).join(named, ["file", "rec_no"]).select(doc_id.alias("doc_id"), "crc", "record_bytes")


def chunked_runs(spark, sf_dir):
    """Runs of lower case over chunks of sizes that differ by document."""
    rows = chunks.cut(records(spark, sf_dir, kept(FOUR)), (F.lit(50) + F.pmod("doc_id", F.lit(300))).cast("int"))
    return chunks.case_runs(rows).select(F.col("rec_no").alias("doc_id"), "run_no", "start", "len")


def container_chunks(spark, sf_dir):
    """Containers read by chunks of 1,000 symbols; most records span several, which are unpacked by tasks of their own."""
    path = scratch(spark, "by-chunks")
    container.write_records(records(spark, sf_dir), path)
    rows = chunks.saved(chunk_scan.read_chunks(spark, path, size=1000), "read-chunks")
    named = rows.where("chunk_no = 0").select("file", "rec_no", F.regexp_extract("description", "^doc([0-9]+)", 1).cast("long").alias("doc_id"))
    return rows.drop("description").join(named, ["file", "rec_no"]).select("doc_id", "chunk_no", "start", "n", "nuc", F.decode("data", "US-ASCII").alias("symbols"))


def container_size(spark, sf_dir):
    return sizes.container_size(records(spark, sf_dir))


def damaged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Records with many equal descriptions, and the same with planted faults."""
    rows = records(spark, sf_dir, kept(THREE))
    name = F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), F.coalesce("source", F.lit("")), F.lit("|"), F.pmod("doc_id", F.lit(50)))
    rows = rows.select("rec_no", name.alias("description"), "sequence")
    fault = F.when(F.pmod("rec_no", F.lit(7)) == 0, F.substring(seq(), F.lit(2), F.length(seq()))).when(F.pmod("rec_no", F.lit(11)) == 0, F.translate(seq(), "U", "T")).otherwise(seq())
    return rows, rows.withColumns({"sequence": fault, "description": F.when(F.pmod("rec_no", F.lit(97)) == 0, "nowhere").otherwise(F.col("description"))})


def integrity_summary(spark, sf_dir):
    return integrity.summary(*damaged(spark, sf_dir))


def integrity_details(spark, sf_dir):
    return integrity.details(*damaged(spark, sf_dir))


def integrity_report(spark, sf_dir):
    """The first ten details."""
    return integrity.first_details(integrity_details(spark, sf_dir))


def in_chunks(spark, sf_dir) -> digests.ChunkReport:
    """The same damaged records in chunks, which are cut differently on the two sides."""
    rows = [r.withColumn("file", F.lit("docs")) for r in damaged(spark, sf_dir)]
    size = lambda k: (F.lit(100) + F.pmod("rec_no", F.lit(k))).cast("int")
    rows = [chunks.saved(chunks.cut(r, size(k)), "damaged") for r, k in zip(rows, (90, 250))]
    return digests.ChunkReport(*rows, size=256, fan=16)


def integrity_chunks(spark, sf_dir):
    rows = in_chunks(spark, sf_dir).details()
    return rows.select(*[F.col(c).cast("int").alias(c) if c in ("first_diff_at", "orig_T", "orig_U", "dec_T", "dec_U") else c for c in rows.columns])


def integrity_chunks_summary(spark, sf_dir):
    return in_chunks(spark, sf_dir).summary()


def sequence_names(spark, sf_dir):
    return integrity.sequence_names(damaged(spark, sf_dir)[0])


def last_of_each(spark, sf_dir):
    return integrity.last_of_each(integrity.facts(damaged(spark, sf_dir)[0])).select("description", F.col("original_sha").alias("sha"))


def sha256_sequences(spark, sf_dir):
    return records(spark, sf_dir, kept(THREE)).select("doc_id", F.sha2(seq(), 256).alias("sha"))


def total_bp(spark, sf_dir):
    return sizes.total_bases(records(spark, sf_dir))


def ncf_by_lang(spark, sf_dir):
    rows = records(spark, sf_dir).select(F.coalesce("lang", F.lit("none")).alias("lang"), bases.n_bases(seq()).alias("n"), bases.encoding(seq()).alias("enc"))
    out = rows.groupBy("lang").agg(F.sum("n").alias("total_bp"), F.sum(bases.packed_size(F.col("n"), F.col("enc"))).alias("packed_bytes"))
    return out.withColumn("bases_per_byte", F.try_divide(F.col("total_bp").cast("double"), F.col("packed_bytes").cast("double")))


def edit_text_render(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", edit_text.rendered(F.col("description"), seq(), F.col("nuc")).alias("rendered"))


def edit_text_parse(spark, sf_dir):
    hint = F.element_at(F.array(F.lit(" | NUC="), F.lit(" | nuc="), F.lit(" |  Nuc= ")), F.pmod("doc_id", F.lit(3)).cast("int") + 1)
    record = F.replace(edit_text.rendered(F.col("description"), seq(), F.col("nuc")), F.lit(" | NUC="), hint)
    text = F.concat(F.lit(edit_text.HEAD), record, F.lit("\n\n"))
    rows = edit_text.parse(records(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), text.alias("text")))
    return rows.select(F.col("file").cast("long").alias("doc_id"), "rec_no", "description", "sequence", "nuc_hint", "problem")


def edit_text_blocks(spark, sf_dir):
    """Two records a text, every seventh with a stray line between them, read in blocks of one to five lines."""
    again = F.concat(F.lit(">"), F.col("description"), F.lit(" again | nuc=rna\n"), seq(), F.lit("\n"))
    stray = F.when(F.pmod("doc_id", F.lit(7)) == 0, "ACGT\n# between\n").otherwise("")
    text = F.concat(F.lit(edit_text.HEAD), edit_text.rendered(F.col("description"), seq(), F.col("nuc")), F.lit("\n\n"), stray, again)
    rows = records(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("file"), text.alias("text"))
    lines = rows.select("doc_id", "file", F.posexplode(F.split("text", "\n", -1)).alias("at", "value"))
    block = F.floor(F.col("at") / (1 + F.pmod("doc_id", F.lit(5))))
    rows = edit_text.parse_blocks(lines.select("file", block.alias("block"), F.encode("value", "UTF-8").alias("value")), rows.select("file"))
    return rows.select(F.col("file").cast("long").alias("doc_id"), "rec_no", "description", "sequence", "nuc_hint", "problem")


def edit_text_encode(spark, sf_dir):
    """Texts parsed and turned into records of bytes: the checksum and size of each."""
    text = F.concat(F.lit(edit_text.HEAD), edit_text.rendered(F.col("description"), seq(), F.col("nuc")), F.lit("\n\n"))
    rows = edit_text.parse(records(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), text.alias("text")))
    record = container.record_bytes(F.col("description"), seq(), bases.nucleotide(seq(), F.col("nuc_hint")))
    size = F.octet_length("record")
    return rows.select(F.col("file").cast("long").alias("doc_id"), record.alias("record")).select("doc_id", F.crc32(F.substring("record", F.lit(1), size - 4)).alias("crc"), size.cast("long").alias("record_bytes"))


def record_violations(spark, sf_dir):
    rows = records(spark, sf_dir, kept("QZ-")).withColumn("nuc", F.when(F.pmod("doc_id", F.lit(13)) == 0, "protein").otherwise("DNA"))
    return edit_text.violations(rows).select("rec_no", "reason")


def fasta_roundtrip(spark, sf_dir):
    path = scratch(spark, "fasta")
    fasta.write_fasta(records(spark, sf_dir), path)
    return fasta.read_fasta(spark, path).select("id", "description", "sequence")


def container_roundtrip(spark, sf_dir):
    path = scratch(spark, "container")
    container.write_records(records(spark, sf_dir), path)
    return container.read_records(spark, path).select("description", "sequence", "nuc")


def container_by_blocks(spark, sf_dir):
    """Files read by the block index that the sink left, in pieces of some kB."""
    path = scratch(spark, "blocks")
    container.write_records(records(spark, sf_dir), path, block=1 << 14)
    return container.read_records(spark, path, span=1 << 15).select("description", "sequence", "nuc")


def container_by_search(spark, sf_dir):
    """The same files without their index, as those of others: ranges find their records by checksums."""
    path = scratch(spark, "search")
    container.write_records(records(spark, sf_dir), path)
    return container.read_records(spark, f"{commits.current(spark, path)}/*.seqs", span=1 << 15).select("description", "sequence", "nuc")


def container_sql(spark, sf_dir):
    """Written and read as a data source, in SQL, with the codec's functions."""
    path = scratch(spark, "source")
    surface.register(spark)
    records(spark, sf_dir).select("file", "description", "sequence", "nuc").write.format("basewright").mode("overwrite").save(path)
    view = f"records_{path.rpartition('/')[2]}".replace("-", "_")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} USING basewright OPTIONS (path '{path}')")
    return spark.sql(f"SELECT description, sequence, nuc, record_encoding(sequence) AS enc, octet_length(record_bytes(description, sequence, nuc)) AS record_bytes FROM {view}")


def container_table_function(spark, sf_dir):
    """Files of a table, each read by a table function."""
    path = scratch(spark, "lateral")
    surface.register(spark)
    container.write_records(records(spark, sf_dir), path)
    files = spark.read.format("binaryFile").load(f"{commits.current(spark, path)}/*.seqs").select("path")
    view = f"files_{path.rpartition('/')[2]}".replace("-", "_")
    files.createOrReplaceTempView(view)
    return spark.sql(f"SELECT r.description, r.sequence, r.nuc FROM {view} f, LATERAL container_records(f.path) r")


def legacy_roundtrip(spark, sf_dir):
    path = scratch(spark, "legacy")
    container.write_records(records(spark, sf_dir, kept(LEGACY)), path, version=1, any_bit=False)
    return container.read_records(spark, path).select("description", "sequence", "nuc")


def converted(spark, sf_dir, convert_files, **options):
    path = scratch(spark, "convert")
    fasta.write_fasta(records(spark, sf_dir, kept(FOUR)), f"{path}/in")
    done = convert_files(spark, f"{path}/in", f"{path}/out", **options)
    written = done.manifest.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("written"))
    return done.summary.crossJoin(written).withColumn("mixed", F.lit(done.mixed).cast("long"))  # one row each


def convert_and_verify(spark, sf_dir):
    """Records that mix T and U lose one of them; the report has to say so, and all records have to come back."""
    return converted(spark, sf_dir, convert.convert_fasta)


def convert_long_and_verify(spark, sf_dir):
    """The same by chunks from end to end: no sequence is ever one value."""
    return converted(spark, sf_dir, convert.convert_long, size=4096)


def edit_text_roundtrip(spark, sf_dir):
    path = scratch(spark, "edit-text")
    edit_text.write_edit_text(records(spark, sf_dir), path)
    return edit_text.read_edit_text(spark, path, mode="PERMISSIVE").select("description", "sequence", "nuc", "problem")


def save_roundtrip(spark, sf_dir):
    """Two saves to one folder: the second replaces the first."""
    path, rows = scratch(spark, "save"), records(spark, sf_dir).where(seq() != "")
    edit_text.save(rows.where("doc_id % 2 = 0"), path)
    return edit_text.save(rows, path).select("description", "sequence", "nuc")


def compressed_roundtrip(spark, sf_dir):
    path = scratch(spark, "compressed")
    fasta.write_fasta(records(spark, sf_dir), f"{path}/in")
    for method, before, after in (("pigz", "in", "gz"), ("bz2", "gz", "bz")):
        compressed.compress_files(spark, f"{path}/{before}", f"{path}/{after}", method, threads=2)
    for method, before, after in (("bz2", "bz", "gz-back"), ("pigz", "gz-back", "back")):
        compressed.compress_files(spark, f"{path}/{before}", f"{path}/{after}", method, decompress=True)
    return fasta.read_fasta(spark, f"{path}/back").select("description", "sequence")


def file_sizes(spark, sf_dir):
    """Bytes of all containers that were written, without their heads of 12 bytes, as the file system and as the manifest have them."""
    path = scratch(spark, "sizes")
    manifest = container.write_records(records(spark, sf_dir), path)
    size = lambda n: (F.coalesce(F.sum(n), F.lit(0)) - 12 * F.count("*"))
    there = compressed.file_sizes(spark, f"{commits.current(spark, path)}/*.seqs").agg(size("size_bytes").alias("size_bytes"))
    return there.crossJoin(manifest.agg(size("bytes").alias("written")))  # one row each


def encoded_stream(spark, sf_dir):
    path = scratch(spark, "stream")
    rows = records(spark, sf_dir).select("description", "sequence", "nuc")
    rows.write.parquet(f"{path}/in")
    encode.encode_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("description", "enc", "bad_symbol", "n_bases", F.octet_length("record").cast("long").alias("record_bytes"))


def variant_sizes(spark, sf_dir):
    rows = records(spark, sf_dir)
    total = sizes.total_bases(rows).first()[0]
    return sizes.bases_per_byte(sizes.variant_sizes(rows), total)


def plain_sizes(spark, sf_dir):
    rows = records(spark, sf_dir)
    return sizes.bases_per_byte(sizes.plain_sizes(rows), sizes.total_bases(rows).first()[0])


def output_names(spark, sf_dir):
    name = F.concat(F.lit("x.fasta/doc"), "doc_id", F.lit(".fasta"))
    method = F.element_at(F.array(*map(F.lit, compressed.SUFFIXES)), F.pmod("doc_id", F.lit(3)).cast("int") + 1)
    return documents(spark, sf_dir).select("doc_id", compressed.output_name(name).alias("container"), compressed.compressed_name(name, method).alias("compressed"))


QUERIES = {
    "encoding_histogram": encoding_histogram, "alphabet_violations": alphabet_violations,
    "pack_2b": packed(TWO, bases.pack_2b), "pack_3b": packed(THREE, bases.pack_3b), "pack_4b": packed(FOUR, bases.pack_4b),
    "unpack_roundtrip": unpack_roundtrip, "softmask_runs": softmask_runs, "softmask_apply": softmask_apply,
    "nuc_type": nuc_type, "mixed_tu": mixed_tu, "v1_record_hex": v1_record_hex, "v1_decode": v1_decode,
    "v1_decode_types": v1_decode_types, "shortened": shortened, "v1_marker_guard": v1_marker_guard, "v2_record_body": v2_record_body, "v2_record_crc": v2_record_crc,
    "chunked_records": chunked_records, "chunked_runs": chunked_runs, "container_chunks": container_chunks, "container_size": container_size, "integrity_summary": integrity_summary, "integrity_details": integrity_details, "integrity_report": integrity_report, "integrity_chunks": integrity_chunks, "integrity_chunks_summary": integrity_chunks_summary,
    "sequence_names": sequence_names, "last_of_each": last_of_each, "sha256_sequences": sha256_sequences,
    "total_bp": total_bp, "ncf_by_lang": ncf_by_lang, "edit_text_render": edit_text_render,
    "edit_text_parse": edit_text_parse, "edit_text_blocks": edit_text_blocks, "edit_text_encode": edit_text_encode, "record_violations": record_violations, "fasta_roundtrip": fasta_roundtrip,
    "container_roundtrip": container_roundtrip, "container_by_blocks": container_by_blocks, "container_by_search": container_by_search, "container_sql": container_sql, "container_table_function": container_table_function, "legacy_roundtrip": legacy_roundtrip,
    "convert_and_verify": convert_and_verify, "convert_long_and_verify": convert_long_and_verify, "edit_text_roundtrip": edit_text_roundtrip, "save_roundtrip": save_roundtrip,
    "compressed_roundtrip": compressed_roundtrip, "file_sizes": file_sizes, "encoded_stream": encoded_stream,
    "plain_sizes": plain_sizes, "variant_sizes": variant_sizes, "output_names": output_names,
}

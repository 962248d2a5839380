"""Operators on sequencing reads: the base codec, FASTQ records, alignment flags, coordinate order, assembly of columns, duplicate marking."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.session import cut

#: Fixed values of the packed-base format: three bits a base, 21 bases a word, and a mark after the last base.
BASES = {"A": 0, "C": 1, "T": 2, "G": 3, "N": 4}
END = 7
BASES_A_WORD = 21
#: Fixed values of an aligner's two-bit alphabet, which has another order.
TWO_BIT = ("ACGTN", "01234")
#: Fixed bits of the alignment flag.
FLAGS = {
    "paired": 0x1,
    "proper_pair": 0x2,
    "unmapped": 0x4,
    "next_unmapped": 0x8,
    "reverse": 0x10,
    "next_reverse": 0x20,
    "first": 0x40,
    "last": 0x80,
    "secondary": 0x100,
    "filtered": 0x200,
    "duplicate": 0x400,
    "supplemental": 0x800,
}


def pack_bases(bases: str) -> list[int]:
    """The words of a read. One of a multiple of 21 bases gets a word that holds the end mark alone."""
    codes = []
    for letter in bases.upper():
        if letter not in BASES:
            raise ValueError(f"not a base: {letter!r}")
        codes.append(BASES[letter])
    codes.append(END)
    return [sum(c << (3 * k) for k, c in enumerate(codes[at : at + BASES_A_WORD])) for at in range(0, len(codes), BASES_A_WORD)]


def unpack_bases(words: list[int]) -> str:
    letters = {c: b for b, c in BASES.items()}
    out = []
    for word in words:
        for k in range(BASES_A_WORD):
            code = word >> (3 * k) & 7
            if code == END:
                return "".join(out)
            out.append(letters[code])
    raise ValueError("no end mark")


def encode_bases(bases: Column | str) -> Column:
    """The words of a read, as ``pack_bases``, within the JVM: three bits are an octal digit, so a word is a number of 21 of these, the last base first."""
    bases = F.col(bases) if isinstance(bases, str) else bases
    upper = F.upper(bases)
    letters = "".join(BASES)
    digits = F.translate(upper, letters, "".join(str(BASES[c]) for c in letters))
    checked = F.when(upper.rlike(rf"^[{letters}]*\z"), F.concat(digits, F.lit(str(END)))).otherwise(F.raise_error(F.concat(F.lit("not a base in "), bases)).cast("string"))
    words = F.regexp_extract_all(checked, F.lit(f"(.{{1,{BASES_A_WORD}}})"), F.lit(1))
    return F.when(bases.isNotNull(), F.transform(words, lambda w: F.conv(F.reverse(w), 8, 10).cast("long")))


def decode_bases(words: Column | str) -> Column:
    """The read of packed words; one without an end mark is an error."""
    words = F.col(words) if isinstance(words, str) else words
    octal = lambda w: F.reverse(F.lpad(F.conv(w.bitwiseAND(F.lit((1 << 3 * BASES_A_WORD) - 1)).cast("string"), 10, 8), BASES_A_WORD, "0"))
    digits = F.regexp_extract(F.array_join(F.transform(words, octal), "", "?"), f"^([^{END}]*){END}", 0)
    letters, codes = "".join(BASES), "".join(map(str, BASES.values()))
    known = F.when(digits.rlike(f"^[{codes}]*{END}"), digits).otherwise(F.raise_error(F.when(digits == "", F.lit("no end mark")).otherwise(F.lit("not the code of a base"))).cast("string"))
    return F.when(words.isNotNull(), F.translate(known, codes + str(END), letters))


def packed_bytes(words: Column) -> Column:
    """The words as bytes, least first: what a column of packed bases stores."""
    turned = F.array_join(F.transform(words, lambda w: F.reverse(F.lpad(F.hex(w), 16, "0"))), "")  # digits of a byte are still the wrong way round
    return F.unhex(F.regexp_replace(turned, "(.)(.)", "$2$1"))


def convert_reads(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, bases, qual, meta) as the three columns of a dataset store them: bases packed, qualities and names as bytes."""
    return df.select(ordinal, packed_bytes(encode_bases("bases")).alias("bases"), F.col("quals").cast("binary").alias("qual"), F.col("meta").cast("binary").alias("meta"))


def convert_bases(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A text column of bases, record by record, in its packed form, with each record's new length."""
    packed = packed_bytes(encode_bases(F.col(payload).cast("string")))
    return df.withColumn(payload, packed).withColumn("length", F.octet_length(payload))


def two_bit(bases: Column) -> Column:
    """Digits 0 to 4 for the letters; another letter is an error."""
    upper = F.upper(bases)
    return F.when(upper.rlike("^[ACGTN]*$"), F.translate(upper, *TWO_BIT)).otherwise(F.raise_error(F.lit("not a base")).cast("string"))


def flag(column: Column, name: str) -> Column:
    return column.bitwiseAND(F.lit(FLAGS[name])) != 0


def is_primary(column: Column) -> Column:
    return ~flag(column, "secondary") & ~flag(column, "supplemental")


def flagstat(df: DataFrame, column: str = "flag") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(flag(F.col(column), n)).alias(n) for n in FLAGS], F.count_if(~flag(F.col(column), "unmapped")).alias("mapped"), F.count_if(is_primary(F.col(column))).alias("primary"))


def fastq_records(lines: DataFrame, order: str, chunk_size: int) -> DataFrame:
    """(record, chunk, meta, bases, quals) from lines with dense positions ``order``; a last record of fewer than four lines is dropped."""
    at = F.col(order)
    part = lambda k: F.max(F.when(at % 4 == k, F.col("line")))
    met = lines.withColumn("record", F.floor(at / 4)).repartition("record")  # texts are grouped by sorting: not before they are dealt, when a task has all that was read
    records = met.groupBy("record").agg(part(0).alias("_meta"), part(1).alias("bases"), part(3).alias("quals"), F.count(F.lit(1)).alias("_n")).where("_n = 4")
    meta = F.when(F.col("_meta").startswith("@"), F.expr("substring(_meta, 2)")).otherwise(F.col("_meta"))
    return records.select("record", F.floor(F.col("record") / chunk_size).alias("chunk"), meta.alias("meta"), F.expr("substring(bases, 1, length(quals))").alias("bases"), "quals")


def chunks(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    """(chunk, first_ordinal, last_ordinal, n): the last is exclusive."""
    found = df.groupBy(F.floor(F.col(ordinal) / size).alias("chunk")).agg(F.min(ordinal).alias("first_ordinal"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("last_ordinal", F.col("first_ordinal") + F.col("n"))


def assemble(bases: DataFrame, quals: DataFrame, meta: DataFrame | None = None, keys: tuple[str, ...] = ("record_id", "ordinal")) -> DataFrame:
    """Columns of one dataset side by side by ordinal; a column may be left out."""
    out = bases.join(quals, [*keys])
    return out.join(meta, [*keys]) if meta is not None else out


#: Fixed order of an alignment's stored fields.
ALIGNMENT = (("ref_index", "int"), ("position", "long"), ("mapping_quality", "int"), ("flag", "int"), ("cigar", "string"), ("next_ref_index", "int"), ("next_position", "long"), ("template_length", "long"))


def alignment_result(fields: dict[str, Column]) -> Column:
    """One alignment as a struct; fields not given are 0 or empty. A row without an alignment is null: a gap in its column."""
    empty = {"string": F.lit("")}
    whole = F.struct(*[F.coalesce(fields[n].cast(k), empty.get(k, F.lit(0)).cast(k)).alias(n) if n in fields else empty.get(k, F.lit(0)).cast(k).alias(n) for n, k in ALIGNMENT])
    return F.when(fields["position"].isNotNull(), whole)


def result_payload(result: Column) -> Column:
    """The bytes that stand for a result in its column, fields in fixed order; no bytes for a gap."""
    parts = [result[n].cast("string") for n, _ in ALIGNMENT]
    return F.when(result.isNotNull(), F.concat_ws("\t", *parts).cast("binary")).otherwise(F.lit(b""))


def parsed_payload(payload: Column) -> Column:
    """The result that ``result_payload`` wrote; null for no bytes."""
    parts = F.split(payload.cast("string"), "\t")
    return F.when(F.octet_length(payload) > 0, F.struct(*[F.get(parts, F.lit(k)).cast(kind).alias(n) for k, (n, kind) in enumerate(ALIGNMENT)]))


def results_index(df: DataFrame, result: str = "result", order: str = "ordinal") -> DataFrame:
    """(ordinal, ref_index, position) of a column of results; gaps have none."""
    return df.where(F.col(result).isNotNull()).select(order, F.col(f"{result}.ref_index").alias("ref_index"), F.col(f"{result}.position").alias("position"))


def result_at(df: DataFrame, at: Column, result: str = "result", order: str = "ordinal") -> DataFrame:
    """The result at a position of the column; an error where there is no such row."""
    found = df.where(F.col(order) == at).agg(F.count(F.lit(1)).alias("_n"), F.first(result).alias(result))
    return found.where(F.assert_true(F.col("_n") == 1, F.lit("no result at that position")).isNull()).select(result)


def aligner_options(line: str) -> dict[str, str | bool]:
    """Options of an aligner's command line: -name value, or -name alone for a switch."""
    out: dict[str, str | bool] = {}
    words = line.split()
    for k, word in enumerate(words):
        if word.startswith("-") and not word.lstrip("-").replace(".", "").isdigit():
            follows = words[k + 1] if k + 1 < len(words) else "-"
            out[word.lstrip("-")] = True if follows.startswith("-") and not follows.lstrip("-").replace(".", "").isdigit() else follows
    return out


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(F.upper(bases), "ACGT", "TGCA"))


#: Bases whose runs are cut out at once: what a row of a reference is worked on by.
STRETCH = 4096


def genome_index(references: DataFrame, k: int, most_places: int = 300) -> DataFrame:
    """(kmer, ref_index, position): where each run of k bases stands in the references (ref_index, bases), without those at more than ``most_places`` places, which tell nothing.
    References are cut into stretches, and these into runs, in one pass each. Runs at too many places are few, however many there are in all."""
    stretches = F.regexp_extract_all("bases", F.lit(f"(?s)(?=(.{{1,{STRETCH + k - 1}}})).{{1,{STRETCH}}}"), F.lit(1))
    runs = F.regexp_extract_all(F.upper("part"), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    parts = references.select("ref_index", F.posexplode(stretches).alias("stretch", "part"))
    found = parts.select("ref_index", "stretch", F.posexplode(runs).alias("at", "kmer")).select("kmer", "ref_index", (F.col("stretch").cast("long") * STRETCH + F.col("at")).alias("position"))
    unusual = found.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_places).select("kmer")
    return found.join(unusual, "kmer", "left_anti")


def candidates(reads: DataFrame, index: DataFrame, references: DataFrame, k: int, stride: int, most_mismatches: int) -> DataFrame:
    """(ordinal, ref_index, position, reverse, mismatches): places where a read, or its reverse complement, stands with few mismatches. Seeds every ``stride`` bases meet the index; what they propose is compared base by base.
    Both joins are merges: Spark takes what ``explode`` makes of a table for as small as the table's file, and would broadcast it by way of the driver."""
    both = reads.select("ordinal", F.explode(F.array(F.struct(F.lit(False).alias("reverse"), F.upper("bases").alias("seq")), F.struct(F.lit(True).alias("reverse"), reverse_complement(F.col("bases")).alias("seq")))).alias("s")).select("ordinal", "s.*")
    last = F.length("seq") - k
    seeds = both.where(last >= 0).select("*", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))).alias("at")).withColumn("kmer", F.substr("seq", F.col("at") + 1, F.lit(k)))
    proposed = seeds.join(index.hint("merge"), "kmer").select("ordinal", "reverse", "seq", "ref_index", (F.col("position") - F.col("at")).alias("position")).where("position >= 0").distinct()
    held = references.select(F.col("ref_index").alias("_r"), F.upper("bases").alias("_ref"))
    there = proposed.join(held.hint("merge"), F.col("ref_index") == F.col("_r")).withColumn("_there", F.substr("_ref", (F.col("position") + 1).cast("int"), F.length("seq"))).drop("_ref", "_r").where(F.length("_there") == F.length("seq"))
    differ = F.aggregate(F.zip_with(F.split("seq", ""), F.split("_there", ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    return there.select("ordinal", "ref_index", "position", "reverse", differ.alias("mismatches")).where(F.col("mismatches") <= most_mismatches)


def align_single(reads: DataFrame, index: DataFrame, references: DataFrame, k: int, stride: int = 10, most_mismatches: int = 3, most_secondary: int = 0) -> DataFrame:
    """(ordinal, rank, ref_index, position, flag, mapping_quality): the best place of each read (ordinal, bases), then up to ``most_secondary`` others. A read without a place comes once, unmapped.
    The quality is 60 for a place without rival, 0 where another is as good, and 10 for each mismatch that the next one has more."""
    return best_places(reads, candidates(reads, index, references, k, stride, most_mismatches), most_secondary)


def best_places(reads: DataFrame, found: DataFrame, most_secondary: int = 0) -> DataFrame:
    """What ``align_single`` gives, of the ``candidates`` found. Each read's ordinal comes behind its candidates, so that these are gone through once."""
    last = reads.select("ordinal", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("ref_index", "position", "reverse", "mismatches")], F.lit(True).alias("_last"))
    window = Window.partitionBy("ordinal").orderBy("_last", "mismatches", "ref_index", "position", "reverse")
    ranked = found.withColumn("_last", F.lit(False)).unionByName(last).withColumns({"rank": F.row_number().over(window) - 1, "_next": F.lead("mismatches").over(window), "_lost": F.first("_last").over(window)})
    placed, none = ~F.col("_last") & (F.col("rank") <= most_secondary), F.col("_last") & F.col("_lost")
    quality = F.when(none | (F.col("rank") > 0), 0).when(F.col("_next").isNull(), 60).otherwise(F.least(F.lit(60), 10 * (F.col("_next") - F.col("mismatches"))))
    flags = F.when(none, FLAGS["unmapped"]).otherwise(F.when(F.col("reverse"), FLAGS["reverse"]).otherwise(0) + F.when(F.col("rank") > 0, FLAGS["secondary"]).otherwise(0))
    here = lambda c: F.when(none, F.lit(-1)).otherwise(F.col(c)).alias(c)
    return ranked.where(placed | none).select("ordinal", F.when(none, 0).otherwise(F.col("rank")).alias("rank"), here("ref_index"), here("position"), flags.alias("flag"), quality.alias("mapping_quality"))


def insert_sizes(pairs: DataFrame) -> DataFrame:
    """(low, high): mean inner distance of the pairs' (size) give or take four deviations: what a proper pair may measure. One row."""
    return pairs.agg(F.avg("size").alias("m"), F.coalesce(F.stddev_pop("size"), F.lit(0.0)).alias("d")).select((F.col("m") - 4 * F.col("d") - 1).alias("low"), (F.col("m") + 4 * F.col("d") + 1).alias("high"))


def align_paired(reads: DataFrame, index: DataFrame, references: DataFrame, k: int, stride: int = 10, most_mismatches: int = 3) -> DataFrame:
    """(ordinal, ref_index, position, flag): reads in pairs, ordinals 2i and 2i + 1; an odd number of reads is an error. First the reads with one place each tell the usual distance, then each pair takes the
    places of least mismatches on one reference, on opposite strands, within it; a pair without such places is aligned read by read. Candidates and pairs are checkpointed: each is asked for again and again."""
    n = reads.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") % 2 == 0, F.lit(True)).otherwise(F.raise_error(F.lit("an odd number of reads can't be paired")).cast("boolean")).alias("even"))
    reads = reads.join(F.broadcast(n), F.col("even")).drop("even")
    found = cut(candidates(reads, index, references, k, stride, most_mismatches).withColumn("pair", F.floor(F.col("ordinal") / 2)))
    side = lambda odd, p: found.where(F.col("ordinal") % 2 == odd).select("pair", "ref_index", *[F.col(c).alias(p + c) for c in ("position", "reverse", "mismatches")])
    met = side(0, "a_").join(side(1, "b_"), ["pair", "ref_index"]).where(F.col("a_reverse") != F.col("b_reverse")).withColumn("size", F.abs(F.col("a_position") - F.col("b_position")))
    alone = found.groupBy("ordinal").agg(F.count(F.lit(1)).alias("c")).where("c = 1").groupBy(F.floor(F.col("ordinal") / 2).alias("pair")).agg(F.count(F.lit(1)).alias("c")).where("c = 2").select("pair")
    bound = insert_sizes(met.join(alone, "pair", "left_semi"))
    proper = met.join(F.broadcast(bound), (F.col("size") >= F.col("low")) & (F.col("size") <= F.col("high")))
    best = cut(proper.groupBy("pair").agg(F.min(F.struct((F.col("a_mismatches") + F.col("b_mismatches")).alias("m"), "size", "ref_index", "a_position", "b_position", "a_reverse", "b_reverse")).alias("s")).select("pair", "s.*"))
    common = FLAGS["paired"] + FLAGS["proper_pair"]
    strand = lambda c, bit: F.when(F.col(c), FLAGS[bit]).otherwise(0)
    one = best.select((F.col("pair") * 2).alias("ordinal"), "ref_index", F.col("a_position").alias("position"), (F.lit(common + FLAGS["first"]) + strand("a_reverse", "reverse") + strand("b_reverse", "next_reverse")).alias("flag"))
    two = best.select((F.col("pair") * 2 + 1).alias("ordinal"), "ref_index", F.col("b_position").alias("position"), (F.lit(common + FLAGS["last"]) + strand("b_reverse", "reverse") + strand("a_reverse", "next_reverse")).alias("flag"))
    rest = reads.select("ordinal", F.floor(F.col("ordinal") / 2).alias("pair")).join(best, "pair", "left_anti")
    single = best_places(rest, found.join(best, "pair", "left_anti").drop("pair")).select("ordinal", "ref_index", "position", (F.col("flag") + FLAGS["paired"] + F.when(F.col("ordinal") % 2 == 0, FLAGS["first"]).otherwise(FLAGS["last"])).alias("flag"))
    return one.unionByName(two).unionByName(single)


def align_with(reads: DataFrame, aligner: Callable, schema: str, batch: int = 2048, paired: bool = False) -> DataFrame:
    """What an external aligner gives for pandas frames of ``batch`` reads (a pair is never parted). ``aligner`` is called once a task to load its index and gives the function that aligns."""

    def run(batches):
        align, held = aligner(), None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            while len(held) >= batch:
                yield align(held.iloc[:batch])
                held = held.iloc[batch:]
        if held is not None and len(held):
            if paired and len(held) % 2:
                raise ValueError("an odd number of reads can't be paired")
            yield align(held)

    if paired and batch % 2:
        raise ValueError("a batch of pairs is even")
    dealt = reads.repartition(F.floor(F.col("ordinal") / 2)).sortWithinPartitions("ordinal") if paired else reads
    return dealt.mapInPandas(run, schema)


def mark_duplicates(df: DataFrame, signature: list[str], quality: str, order: str) -> DataFrame:
    """``df`` with ``duplicate``: all rows of a signature but the one of best quality, the first of equal ones."""
    window = Window.partitionBy(*signature).orderBy(F.col(quality).desc(), order)
    return df.withColumn("duplicate", F.row_number().over(window) > 1)


def reference_lengths(references: DataFrame) -> DataFrame:
    """(ref_index, name, length) of the references (ref_index, name, bases)."""
    return references.select("ref_index", "name", F.length("bases").alias("length"))


def references(df: DataFrame, name: str, order: str) -> DataFrame:
    """One row: the names of all references in order, joined by |."""
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(name).alias("_n")))), lambda x: x["_n"]), "|").alias("names"))

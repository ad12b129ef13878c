"""From text lines to numbered task statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspan.functions import text as T
from weftspan.plans.ranking import carry_forward
from weftspan.plans.storage import materialise

MARK, SEP = "\u0001", "\u0002"


def drop_furniture(lines: DataFrame, text: str = "text") -> DataFrame:
    """Remove page headers, footers and page numbers."""
    return lines.filter(~T.is_furniture(text))


def segment_by_code(lines: DataFrame) -> DataFrame:
    """(file, code, seq, lines): the text lines between one code and the next.

    ``lines`` holds (file, page, line_no, text). A code may stand anywhere in a
    line, so lines are cut at codes first; the code is then carried forward
    over the pieces of its file. ``seq`` is the place of the code in the file.
    """
    marked = F.split(F.regexp_replace("text", T.CODE, f"{MARK}$1{SEP}"), MARK)
    pieces = lines.select(
        "file", "page", "line_no", F.posexplode(marked).alias("piece_no", "piece")
    )
    opens = F.col("piece_no") > 0
    pieces = pieces.withColumn(
        "mark",
        F.when(
            opens,
            F.struct(
                F.substring_index("piece", SEP, 1).alias("code"),
                F.col("page").alias("page"),
                F.col("line_no").alias("line_no"),
                F.col("piece_no").alias("piece_no"),
            ),
        ),
    ).withColumn(
        "piece", F.when(opens, F.substring_index("piece", SEP, -1)).otherwise(F.col("piece"))
    )
    carried = carry_forward(pieces, ["file"], "page", ["line_no", "piece_no"], ["mark"])
    return (
        carried.filter(F.col("mark").isNotNull())
        .groupBy("file", "mark")
        .agg(F.sort_array(F.collect_list(F.struct("page", "line_no", "piece_no", "piece"))).alias("_p"))
        .select(
            "file",
            F.col("mark.code").alias("code"),
            F.struct("mark.page", "mark.line_no", "mark.piece_no").alias("seq"),
            F.col("_p.piece").alias("lines"),
        )
    )


def content_lines(lines: Column) -> Column:
    """Tail sections cut (they run over line ends), then non-empty stripped lines."""
    body = T.cut_tails(F.concat_ws("\n", lines))
    return F.filter(
        F.transform(F.split(body, "\n"), lambda line: T.strip(line)), lambda line: line != ""
    )


def _opening(line: Column) -> Column:
    return F.lower(F.array_join(F.slice(T.words(T.clean_text(line)), 1, 2), " "))


def _title_line_count(lines: Column) -> Column:
    """How many leading lines (0 to 3) form the title.

    A line ends the title if it holds a period, if it opens with a word pair
    already in the title, or if the title so far is longer than 90 characters.
    """
    first, second, third = (F.get(lines, i) for i in range(3))
    plain = [F.coalesce(~F.contains(line, F.lit(".")), F.lit(False)) for line in (first, second, third)]

    def repeats(line: Column, so_far: Column) -> Column:
        opening = _opening(line)
        return (opening != "") & F.contains(F.lower(T.clean_text(so_far)), opening)

    one = plain[0]
    two = one & plain[1] & ~repeats(second, first) & (F.length(first) <= 90)
    both = F.concat_ws(" ", first, second)
    three = (
        two
        & plain[2]
        & ~repeats(third, both)
        & (F.length(first) + F.length(second) <= 90)
    )
    return F.when(three, 3).when(two, 2).when(one, 1).otherwise(0)


def _split_merged_verb(entries: DataFrame) -> DataFrame:
    """Give a verb that was merged onto the title line back to the description.

    The first lower-case token in -s opens the description; so does a pair of
    lower-case tokens that join to such a word (a verb split in the middle).
    Token arrays are columns of their own, so that each is built once per row.
    """

    def opens(word: Column, after: Column) -> Column:
        return word.rlike("^[a-z]{3,}s$") | (
            word.rlike("^[a-z]+$")
            & after.rlike("^[a-z]+$")
            & F.concat(word, after).rlike("^[a-z]{4,}s$")
        )

    staged = (
        entries.withColumn("_tokens", T.words("title"))
        .withColumn("_bare", F.transform("_tokens", lambda t: T.strip_marks(t)))
        .withColumn("_n", F.size("_tokens"))
        .withColumn("_next", F.concat(F.slice("_bare", 2, F.col("_n")), F.array(F.lit(""))))
        .withColumn("_at", F.array_position(F.zip_with("_bare", "_next", opens), F.lit(True)).cast("int"))
    )
    at = F.col("_at")
    here, after = F.get("_bare", at - 1), F.get("_next", at - 1)
    rest = F.when(
        here.rlike("^[a-z]{3,}s$"), F.array_join(F.slice("_tokens", at, F.col("_n")), " ")
    ).otherwise(
        F.concat_ws(
            " ", F.concat(here, after), F.array_join(F.slice("_tokens", at + 2, F.col("_n")), " ")
        )
    )
    kept = T.rstrip_marks(T.clean_text(F.array_join(F.slice("_tokens", F.lit(1), at - 1), " ")))
    found = F.coalesce(at > 0, F.lit(False))
    rest_of = [c for c in entries.columns if c not in ("title", "description")]
    return staged.select(
        *rest_of,
        F.when(found, kept).otherwise(F.col("title")).alias("title"),
        F.when(found, F.trim(F.concat_ws(" ", rest, F.col("description"))))
        .otherwise(F.col("description"))
        .alias("description"),
    )


def collapse_titles(entries: DataFrame) -> DataFrame:
    """Drop a repeated leading phrase of up to six words (longest first);
    case, trailing commas and plural -s do not matter."""
    staged = (
        entries.withColumn("_tokens", T.words("title"))
        .withColumn(
            "_plain",
            F.transform(
                "_tokens", lambda w: F.regexp_replace(T.rstrip_marks(F.lower(w)), "s+$", "")
            ),
        )
        .withColumn("_n", F.size("_tokens"))
    )
    repeat = F.lit(0)
    for n in range(1, 7):
        same = (F.col("_n") >= 2 * n) & (F.slice("_plain", 1, n) == F.slice("_plain", n + 1, n))
        repeat = F.when(same, F.lit(n)).otherwise(repeat)
    staged = staged.withColumn("_repeat", repeat)
    shorter = F.when(F.col("_repeat") == 0, F.col("title")).otherwise(
        F.array_join(F.slice("_tokens", F.col("_repeat") + 1, F.col("_n")), " ")
    )
    tidy = F.regexp_replace(
        F.regexp_replace(shorter, r"\s+([;,])", "$1"), "^[ ;,]+|[ ;,]+$", ""
    )
    rest_of = [c for c in entries.columns if c != "title"]
    return staged.select(*rest_of, tidy.alias("title"))


def split_entries(segments: DataFrame) -> DataFrame:
    """Segments to entries with title, description and code prefixes; entries
    without a title or with under 40 characters of description are dropped.

    The parsed table is written once: a filter over it would otherwise be
    moved below all text steps and repeat each of them.
    """
    staged = segments.withColumn("lines", content_lines(F.col("lines")))
    staged = staged.withColumn("_k", _title_line_count(F.col("lines"))).select(
        "file", "code", "seq",
        T.clean_text(F.concat_ws(" ", F.slice("lines", F.lit(1), F.col("_k")))).alias("title"),
        T.clean_text(
            F.concat_ws(" ", F.slice("lines", F.col("_k") + 1, F.size("lines")))
        ).alias("description"),
    )
    parsed = collapse_titles(_split_merged_verb(staged)).select(
        F.col("code").alias("nco_code"),
        *code_prefixes("code"),
        F.col("title").alias("occupation_title"),
        "description",
        F.col("file").alias("source"),
        "seq",
    )
    return minimum_content(materialise(parsed, "entries"))


def code_prefixes(code: str) -> list[Column]:
    """Family (4), group (3) and division (1) prefixes of an occupation code."""
    return [
        T.prefix(code, 4).alias("family"),
        T.prefix(code, 3).alias("group3"),
        T.prefix(code, 1).alias("division"),
    ]


def minimum_content(
    entries: DataFrame, title: str = "occupation_title", description: str = "description"
) -> DataFrame:
    return entries.filter(
        (F.col(title) != "") & (F.length(description) >= T.MIN_DESCRIPTION)
    )


def one_per_code(
    entries: DataFrame, key: str = "nco_code", longest: bool = False
) -> DataFrame:
    """One entry per code: the description that sorts last as text, or the
    longest one. Remaining ties go to the greater source, then title."""
    rest = [c for c in entries.columns if c != key]
    order = [F.col("description"), F.col("source"), F.col("occupation_title")]
    if longest:
        order.insert(0, F.length("description"))
    picked = entries.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_e")
    )
    return picked.select(key, *[F.col(f"_e.{c}").alias(c) for c in rest])


def sentences(text: Column) -> Column:
    return F.split(text, T.SENTENCE_END)


def split_statements(
    entries: DataFrame,
    code: str = "nco_code",
    title: str = "occupation_title",
    description: str = "description",
) -> DataFrame:
    """One numbered statement per sentence, without the leading title alias.

    Statements shorter than 15 characters are dropped before numbering, so ids
    run from 1 without gaps. All work is inside a row: no shuffle.
    """
    aliases = F.filter(
        F.transform(F.split(F.col(title), "[/;]"), lambda a: T.strip(a)), lambda a: a != ""
    )
    longest_first = F.array_sort(aliases, lambda a, b: F.length(b) - F.length(a))

    def cut_at(sentence: Column) -> Column:
        """Sentence and the length of the longest alias it opens with."""
        hit = F.filter(F.col("_aliases"), lambda a: F.startswith(F.lower(sentence), F.lower(a)))
        return F.struct(sentence.alias("s"), F.length(F.get(hit, F.lit(0))).alias("cut"))

    def tail(cut: Column) -> Column:
        rest = F.regexp_replace(F.substr(cut.getField("s"), cut.getField("cut") + 1), "^[ ,]+", "")
        return F.struct(cut.getField("s").alias("s"), rest.alias("rest"))

    def opened(part: Column) -> Column:
        rest = part.getField("rest")
        return F.when(rest.isNull(), part.getField("s")).otherwise(
            F.concat(F.upper(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2)))
        )

    bare = F.transform(
        sentences(F.col(description)),
        lambda s: T.strip(F.regexp_replace(T.strip(s), ";+$", "")),
    )
    texts = F.transform(F.transform(F.transform(bare, cut_at), tail), opened)
    kept = F.filter(texts, lambda s: F.length(s) >= T.MIN_STATEMENT)
    ended = F.transform(
        kept, lambda s: F.when(F.endswith(s, F.lit(".")), s).otherwise(F.concat(s, F.lit(".")))
    )
    others = [c for c in entries.columns if c != description]
    return (
        entries.withColumn("_aliases", longest_first)
        .select(*others, F.posexplode(ended).alias("_i", "task_text"))
        .withColumn("task_no", (F.col("_i") + 1).cast("int"))
        .withColumn(
            "task_id", F.format_string("%s-t%02d", F.col(code).cast("string"), F.col("task_no"))
        )
        .drop("_i")
    )


def flag_fragments(statements: DataFrame, text: str = "task_text") -> DataFrame:
    """Mark designation boilerplate, all-capital strings and short fragments."""
    t = F.col(text)
    return statements.select(
        "*",
        t.rlike(T.DESIGNATION).alias("is_designation"),
        ((t == F.upper(t)) & t.rlike(r"\p{L}")).alias("is_all_caps"),
        (F.length(t) < T.SHORT_STATEMENT).alias("is_short"),
    )


def entry_counts(entries: DataFrame) -> DataFrame:
    """Run report of a parse: entries, families and groups."""
    return entries.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_distinct("family").alias("n_families"),
        F.count_distinct("group3").alias("n_groups3"),
    )


def number_by_order(statements: DataFrame, code: str, order: list[str]) -> DataFrame:
    """Statement numbers when sentences are already rows (bounded per code)."""
    place = F.row_number().over(Window.partitionBy(code).orderBy(*order))
    return statements.withColumn("task_no", place).withColumn(
        "task_id", F.format_string("%s-t%02d", F.col(code).cast("string"), F.col("task_no"))
    )

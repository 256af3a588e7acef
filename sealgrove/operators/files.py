"""Memory files as a table (path, text), and commands on them: one command a path at a time, all paths at once.

Paths of files are clean (functions.text.clean_path); commands may give them in any form, which answers repeat. A command whose path is null answers with an
error and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealgrove.functions.text import clean_path, occurrences_of_column, shown_size

#: Lines that are shown of a file without a range, and the greatest number of its lines.
SHOWN, MOST_LINES = 300, 999_999


def _numbered(lines: Column, first: Column, n: Column) -> Column:
    """Lines from index `first` on with their numbers, as one text."""
    some = F.slice(lines, first + 1, F.greatest(n, F.lit(0)))
    return F.concat(F.array_join(F.transform(some, lambda x, i: F.format_string("%6d\t%s\n", first + i + 1, x)), ""))


def viewed(files: DataFrame, views: DataFrame) -> DataFrame:
    """(path, answer) for views (path, first, last): numbered lines of a file, the first 300 without a range; a last line of -1 is the end."""
    rows = views.withColumn("_file", clean_path(F.col("path"))).join(files.select(F.col("path").alias("_file"), "text"), "_file", "left")
    lines = F.split("text", "\n")
    n = F.size(lines)
    cut = F.col("first").isNull() & F.col("last").isNull() & (n > SHOWN)
    start = F.greatest(F.coalesce("first", F.lit(1)) - 1, F.lit(0))
    end = F.when(cut, F.lit(SHOWN)).when(F.coalesce("last", n) < 0, n).otherwise(F.least(F.coalesce("last", n), n))
    end = F.when(end < start, n).otherwise(end)
    begin = F.least(start, n)
    head = F.when(cut, F.concat(F.lit(f"Here's the first {SHOWN} lines of "), "path", F.lit(" (total: "), n, F.lit(" lines):\n"))).otherwise(F.concat(F.lit("Here's the content of "), "path", F.lit(" with line numbers:\n")))
    tail = F.when(cut, F.concat(F.lit("\n[... "), n - SHOWN, F.lit(" more lines. Use view_range: [start, end] to see specific sections ...]\n"))).otherwise("")
    missing = F.concat(F.lit("The path "), "path", F.lit(" does not exist. Please provide a valid path."))
    long = F.concat(F.lit("File "), "path", F.lit(" exceeds maximum line limit of 999,999 lines."))
    answer = F.when(F.col("path").isNull(), "Error: Missing path").when(F.col("text").isNull(), missing).when(n > MOST_LINES, long).otherwise(F.concat(head, _numbered(lines, begin, end - begin), tail))
    return rows.select("path", answer.alias("answer"))


def listing(files: DataFrame) -> DataFrame:
    """(path, line) of files up to two levels deep: size and place; in order of paths this is the folder's view."""
    near = files.filter(F.size(F.split("path", "/")) <= 2)
    return near.select("path", F.concat(shown_size(F.octet_length("text")), F.lit("\t/memories/"), "path").alias("line"))


def commanded(files: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files after commands (command, path, a, b, line), and each command's answer.

    create: text a; str_replace: a by b, if a occurs once; insert: a after line `line`; delete; rename: to the path a. Of several renames to one path the
    first by path is done.
    """
    own = commands.withColumn("_file", clean_path(F.col("path"))).withColumn("_to", F.when(F.col("command") == "rename", clean_path(F.col("a"))))
    texts = files.select(F.col("path").alias("_file"), F.col("text").alias("_text"))
    goals = files.select(F.col("path").alias("_to"), F.lit(True).alias("_taken"))
    # Goals are looked at before texts come in, and for renames alone, so that no task gets the texts of all others.
    moves = own.filter("_to is not null").join(goals.hint("merge"), "_to", "left")
    nth = F.row_number().over(Window.partitionBy("_to").orderBy("_file"))
    moves = moves.withColumn("_taken", F.coalesce("_taken", F.lit(False)) | (nth > 1))
    rest = own.filter("_to is null").withColumn("_taken", F.lit(False))
    both = rest.unionByName(moves).join(texts.hint("merge"), "_file", "left")
    c, gone, lines = F.col("command"), F.col("_text").isNull(), F.split("_text", "\n")
    n = F.when(c == "str_replace", occurrences_of_column(F.col("_text"), F.col("a")))
    outside = (F.col("line") < 0) | (F.col("line") > F.size(lines))
    found = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(F.contains(x, F.col("a")), (i + 1).cast("string"))), lambda x: x.isNotNull()), ", ")
    new = (
        F.when((c == "create") & gone, F.col("a")).when((c == "str_replace") & (n == 1), F.replace("_text", F.col("a"), F.col("b")))
        .when((c == "insert") & ~gone & ~outside, F.array_join(F.concat(F.slice(lines, F.lit(1), F.col("line")), F.array("a"), F.slice(lines, F.col("line") + 1, F.size(lines))), "\n"))
    )
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]) if isinstance(p, str) else p for p in parts))
    answer = (
        F.when((c == "create") & ~gone, said("Error: File ", "$path", " already exists")).when(c == "create", said("File created successfully at: ", "$path"))
        .when((c == "str_replace") & gone, said("Error: The path ", "$path", " does not exist. Please provide a valid path."))
        .when((c == "str_replace") & (n == 0), said("No replacement was performed, old_str `", "$a", "` did not appear verbatim in ", "$path", "."))
        .when((c == "str_replace") & (n > 1), said("No replacement was performed. Multiple occurrences of old_str `", "$a", "` in lines: ", found, ". Please ensure it is unique"))
        .when(c == "str_replace", "The memory file has been edited.")
        .when(gone, said("Error: The path ", "$path", " does not exist"))
        .when((c == "insert") & outside, said("Error: Invalid `insert_line` parameter: ", "$line", ". It should be within the range of lines of the file: [0, ", F.size(lines), "]"))
        .when(c == "insert", said("The file ", "$path", " has been edited.")).when(c == "delete", said("Successfully deleted ", "$path"))
        .when((c == "rename") & F.col("_taken"), said("Error: The destination ", "$a", " already exists")).when(c == "rename", said("Successfully renamed ", "$path", " to ", "$a"))
    )
    done = both.select("command", "path", "_file", "_to", "_text", "_taken", new.alias("_new"), F.when(F.col("path").isNull(), "Error: Missing path").otherwise(answer).alias("answer"))
    changed = done.filter("_new is not null").select(F.col("_file").alias("path"), F.col("_new").alias("text"))
    moved = done.filter("command = 'rename' and _text is not null and not _taken")
    deleted = done.filter("command = 'delete' and _text is not null")
    out = files.join(changed.select("path").union(moved.select("_file")).union(deleted.select("_file")).distinct(), "path", "left_anti")
    out = out.select("path", "text").unionByName(changed).unionByName(moved.select(F.col("_to").alias("path"), F.col("_text").alias("text")))
    return out, done.select("command", "path", "answer")

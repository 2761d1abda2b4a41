"""Text and JSON sinks: subtitle files and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.time import stamp
from tessera.sources import files

#: Characters that Spark escapes in the folder names of partitions, the percent sign first.
SPECIAL = ["%", *map(chr, range(1, 32)), *"\"#'*/:=?\\\x7f{[]^"]


def srt_block(number: Column, start: Column, end: Column, line: Column) -> Column:
    """One cue as SRT has it, without the blank line that parts cues; numbers begin with 1."""
    return F.concat_ws("\n", number.cast("string"), F.concat_ws(" --> ", stamp(start), stamp(end)), line)


def vtt_block(start: Column, end: Column, line: Column) -> Column:
    return F.concat_ws("\n", F.concat_ws(" --> ", stamp(start, False), stamp(end, False)), line)


def _folder_name(video: Column) -> Column:
    """A value as Spark names the folder of its partition."""
    text = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"%{ord(c):02X}")), SPECIAL, video.cast("string"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))


def write_captions(cues: DataFrame, folder: str, video: str, kind: str = "srt") -> None:
    """A folder per video with one file of its cues (video, cue, start, end, line) in order of ``cue``; what is in ``folder`` before goes.

    A video's cues meet in one row, the text of its file. Spark's own writer commits each file by renames, those of the job one after another on
    the driver; here the tasks that write the files put them where they belong.
    """
    spark = cues.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    sorted_ = F.array_sort(F.collect_list(F.struct("cue", "start", "end", "line")))
    made = (lambda c, i: srt_block(i + 1, c["start"], c["end"], c["line"])) if kind == "srt" else (lambda c: vtt_block(c["start"], c["end"], c["line"]))
    text = F.concat(F.lit("WEBVTT\n\n" if kind == "vtt" else ""), F.array_join(F.transform("cues_", made), "\n\n"), F.lit("\n"))
    texts = cues.groupBy(video).agg(sorted_.alias("cues_"))
    name = F.concat(F.lit(f"{video}="), _folder_name(F.col(video)), F.lit("/captions.txt"))
    files.write_files(texts.select(name.alias("name"), text.cast("binary").alias("content")), folder).count()


def write_report(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines; fields that are null are left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(folder)

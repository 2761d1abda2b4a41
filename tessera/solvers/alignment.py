"""Sequential alignment and keep-first by distance, one bounded group at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.solvers.groups import in_groups


def align(sentences: DataFrame, words: DataFrame, group: str, reach: int = 3) -> DataFrame:
    """Times of sentences from timed words: a cursor moves through the words and is set again within ``reach`` words
    where a sentence's first word stands nearby.

    ``sentences``: group, n, first (its first word), size (words). ``words``: group, i, word, start, end.
    """

    def run(key, kinds, at, texts, sizes, starts, ends):
        m = kinds.count(0)  # the words come first
        text, start, end = texts[:m], starts[:m], ends[:m]
        cursor, out = 0, []
        for n, first, size in zip(at[m:], texts[m:], sizes[m:]) if text else ():
            near = sorted(range(max(0, cursor - reach), min(m, cursor + reach + 1)), key=lambda k: (abs(k - cursor), k))
            begin = next((k for k in near if text[k] == first), min(cursor, m - 1))
            last = min(begin + size - 1, m - 1)
            out.append((key, n, start[begin], end[last]))
            cursor = last + 1
        return out

    kind = sentences.schema[group].dataType.simpleString()
    timed = words.selectExpr(group, "0 AS kind", "cast(i AS long) AS at", "word AS text", "cast(null AS int) AS size", "cast(start AS double) AS start", "cast(end AS double) AS end")
    said = sentences.selectExpr(group, "1 AS kind", "cast(n AS long) AS at", "first AS text", "cast(size AS int) AS size", "cast(null AS double) AS start", "cast(null AS double) AS end")
    return in_groups(timed.unionByName(said), group, ["kind", "at"], run, f"{group} {kind}, n long, start double, end double")


def keep_unlike(rows: DataFrame, group: str, most: int = 6, free: int = 3) -> DataFrame:
    """Keeps rows of each group in order of id whose 64-bit hash (column h) differs from all kept ones in over ``most``
    bits; the first ``free`` rows are kept anyway."""

    def run(key, ids, hashes):
        kept: list[int] = []
        for i, h in zip(ids, hashes):
            good = len(kept) < free or all(((h ^ k) & (1 << 64) - 1).bit_count() > most for k in kept)
            if good:
                kept.append(h)
            yield key, i, good

    kind = rows.schema[group].dataType.simpleString()
    return in_groups(rows.select(group, "id", "h"), group, ["id"], run, f"{group} {kind}, id long, kept boolean")

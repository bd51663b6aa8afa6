"""BM25 over a postings table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed
from ..functions.text import col
from ..session import broadcast_if_small, collect_if_small, cut_lineage, top_n

WORD = r"[\p{L}\p{N}]+"
HAN_RUN = r"^\p{IsHan}+$"
RUNS = r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"
DIGITS = 6                  # scores are compared after rounding, half up, the same way in both search forms
MAX_TERMS = 500_000         # (query, token) pairs sent to the tasks
MAX_CELLS = 20_000_000      # distinct tokens times queries sent to the tasks
PAIRS_AT_ONCE = 1_000_000   # pairs of document and token, or document and query, that one task of the join holds
BYTES_AT_ONCE = 1 << 19     # bytes of short texts whose tokens are counted at a time; a longer text is counted alone


def words(c) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def words_and_han_pairs(c) -> Column:
    """Words; runs of Han characters become overlapping pairs."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(RUNS), F.lit(0))

    def cut(run):
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(HAN_RUN) & (F.length(run) > 1), pairs).otherwise(F.array(run))

    return F.flatten(F.transform(runs, cut))


def occurrences(runs: list[str], terms: set[str], lengths: list[int] | None = None) -> list[str]:
    """Every occurrence of a term in the runs, also overlapping ones, by one look-up per place and length of terms."""
    lengths = sorted({len(t) for t in terms}) if lengths is None else lengths
    return [run[i:i + n] for run in runs for n in lengths for i in range(len(run) - n + 1) if run[i:i + n] in terms]


def _occurrence_lists(runs: pa.Array, terms: set[str]) -> pa.Array:
    """:func:`occurrences` of a column of run lists; only one text at a time leaves its Arrow form."""
    lengths = sorted({len(t) for t in terms})
    kind = pa.list_(pa.string())
    found = lambda r: None if r is None else occurrences(r, terms, lengths)
    return pa.concat_arrays([pa.array([], kind), *(pa.array([found(r.as_py())], kind) for r in runs)])


def with_dictionary(dictionary: DataFrame, term: str = "term", max_terms: int = MAX_TERMS) -> "Tokenizer":
    """A tokenizer: words and Han pairs, and every occurrence of a dictionary term in a run of Han characters.

    Terms are lower-cased; those of fewer than three characters add nothing to the pairs. The
    dictionary is sent to the tasks, so it may hold at most ``max_terms`` terms; a larger one is an error.
    """
    sent = dictionary.sparkSession.sparkContext.broadcast(_terms(dictionary, term, max_terms))

    @F.arrow_udf("array<string>")
    def found(runs: pa.Array) -> pa.Array:
        return _occurrence_lists(runs, sent.value)

    return lambda c: F.concat(words_and_han_pairs(c), found(F.regexp_extract_all(F.lower(col(c)), F.lit(r"\p{IsHan}+"), F.lit(0))))


def _terms(dictionary: DataFrame, term: str, max_terms: int) -> set[str]:
    rows = collect_if_small(dictionary.select(F.lower(F.col(term)).alias("t")).filter(F.length("t") > 2).distinct(), max_terms)
    if rows is None:
        raise ValueError(f"a dictionary may hold at most {max_terms} terms")
    return {r["t"] for r in rows}


def counts_with_dictionary(dictionary: DataFrame, term: str = "term", max_terms: int = MAX_TERMS) -> "Tokenizer":
    """Different tokens of :func:`with_dictionary` and how often each occurs: array of (token, n), in order of the tokens' bytes."""
    sent = dictionary.sparkSession.sparkContext.broadcast(_lookup(_terms(dictionary, term, max_terms)))

    @F.arrow_udf("array<struct<token:string,n:long>>")
    def counted(runs: pa.Array) -> pa.Array:
        return _counted_lists(runs, *sent.value)

    return lambda c: counted(_marked_runs(c))


def _marked_runs(c) -> Column:
    """Runs of a text and whether they are runs of Han characters."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(RUNS), F.lit(0))
    return F.transform(runs, lambda r: F.struct(r.alias("run"), r.rlike(r"^\p{IsHan}").alias("han")))


COUNTED = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))
_CHAR = 21                  # bits of a code point
_MARKS = 20                 # bits of the mark of three characters


def _marks(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (((a << _CHAR | b) << _CHAR | c).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MARKS)


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:][:len(texts) + 1] if len(texts) else np.zeros(1, np.int32)


def _points(texts: pa.Array) -> np.ndarray:
    """Code points of all texts, one after the other."""
    offsets = _offsets(texts)
    data = memoryview(texts.buffers()[2] or b"")[offsets[0]:offsets[-1]]
    return np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)


def _lookup(terms: set[str]) -> tuple[np.ndarray, dict[int, pa.Array]]:
    """Marks of the first three characters of any term, and the terms by length."""
    first = np.array([[ord(x) for x in t[:3]] for t in terms], np.int64).reshape(-1, 3).T
    marked = np.zeros(1 << _MARKS, bool)
    marked[_marks(*first)] = True
    return marked, {n: pa.array(sorted(t for t in terms if len(t) == n)) for n in sorted({len(t) for t in terms})}


def _counted_lists(runs: pa.Array, marked: np.ndarray, terms: dict[int, pa.Array]) -> pa.Array:
    """Counted tokens of every list of runs, some texts at a time."""
    sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes)])
    words, flags = runs.flatten().flatten()
    flags = flags.to_numpy(zero_copy_only=False).astype(bool)
    read = _offsets(words)[first].astype(np.int64)
    done, at = [pa.array([], COUNTED)], 0
    while at < len(runs):
        end = max(at + 1, int(np.searchsorted(read, read[at] + BYTES_AT_ONCE, "right")) - 1)
        part = slice(first[at], first[end])
        done.append(_counted_block(words[part], flags[part], sizes[at:end], runs[at:end].is_null(), marked, terms))
        at = end
    return pa.concat_arrays(done)


def _counted_block(words: pa.Array, flags: np.ndarray, sizes: np.ndarray, null: pa.Array,
                   marked: np.ndarray, terms: dict[int, pa.Array]) -> pa.Array:
    """Tokens are pairs of a text and the place of a token among all tokens of the block; only different ones become strings."""
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    other = words.filter(pa.array(~flags)).dictionary_encode()
    found = [(text_of[~flags], other.indices.to_numpy(), other.dictionary)]
    runs = words.filter(pa.array(flags))
    lengths = pc.utf8_length(runs).to_numpy(zero_copy_only=False)
    c = _points(runs)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(c))
    text_of = np.repeat(text_of[flags], lengths)

    # two characters of a run, or the one of a run of one, as one number
    kept = np.flatnonzero((left > 1) | np.repeat(lengths == 1, lengths))
    next_one = np.where(left > 1, np.append(c[1:], 0)[:len(c)], 0)
    code, both = _numbered((c << _CHAR | next_one)[kept])
    found.append((text_of[kept], code, _strings(np.stack([both >> _CHAR, both & (1 << _CHAR) - 1], 1))))

    # longer ones grow by one character at a time where any term may begin
    more = left[kept] > 2
    at, code, size = kept[more], code[more], 2
    begins = marked[_marks(c[at], c[at + 1], c[at + 2])]
    at, code = at[begins], code[begins]
    for n, known in terms.items():
        fits = left[at] >= n
        at, code = at[fits], code[fits]
        while size < n:
            code, both = _numbered(code << _CHAR | c[at + size])
            size += 1
        first = np.zeros(len(both), np.int64)
        first[code[::-1]] = at[::-1]
        texts = _strings(c[first[:, None] + np.arange(n)])
        listed = pc.is_in(texts, value_set=known).to_numpy(zero_copy_only=False)
        hits = listed[code]
        found.append((text_of[at[hits]], (np.cumsum(listed) - 1)[code[hits]], texts.filter(pa.array(listed))))

    tokens = pa.concat_arrays([values for _, _, values in found])
    order = pc.sort_indices(tokens).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    before = np.cumsum([0] + [len(values) for _, _, values in found])
    counts = pc.value_counts(pa.array(np.concatenate([text * len(order) + rank[at + i] for (text, i, _), at in zip(found, before)])))
    keys = counts.field("values").to_numpy()
    by_key = np.argsort(keys)
    text, token = np.divmod(keys[by_key], max(len(order), 1))
    pairs_of = pa.StructArray.from_arrays([tokens.take(pa.array(order[token])), counts.field("counts").take(pa.array(by_key))], fields=list(COUNTED.value_type))
    offsets = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pairs_of, type=COUNTED, mask=null)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every key among the different keys, and these."""
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def _strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings; zeros at the end count for nothing."""
    n = points.shape[1]
    return pa.array(np.ascontiguousarray(points, np.uint32).view(f"<U{n}").ravel(), pa.string())


Tokenizer = Callable[[str], Column]


def _explode(rows: DataFrame, *kept) -> DataFrame:
    """One row per entry of ``tokens``.

    The outer form keeps the optimizer from guarding the explode with a filter
    that tokenizes every text once more.
    """
    return rows.select(*kept, F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull())


def term_counts(docs: DataFrame, doc_id: str, text: str = "text", tokenizer: Tokenizer = words,
                vocabulary: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(doc_id, token, tf, length) of every document with a token.

    Given a ``vocabulary(token)``, all other tokens are dropped before anything
    is shuffled. Rows are placed by document once: counting terms here and
    summing a document's score later need no further shuffle. ``parts`` fixes the
    number of places, which adaptive execution else sets by bytes.
    """
    tokens = docs.filter(F.col(text).isNotNull()).select(doc_id, tokenizer(text).alias("tokens"))
    rows = _explode(tokens, doc_id, F.size("tokens").alias("length"))
    if vocabulary is not None:
        rows = rows.join(broadcast_if_small(vocabulary.select("token")), "token", "left_semi")
    placed = rows.repartition(parts, doc_id) if parts else rows.repartition(doc_id)
    return placed.groupBy(doc_id, "token").agg(
        F.count("*").alias("tf"), F.first("length").alias("length"))


def corpus_stats(docs: DataFrame, text: str = "text", tokenizer: Tokenizer = words) -> DataFrame:
    """One row: number of documents with a token, and their mean length."""
    sized = docs.filter(F.col(text).isNotNull()).select(F.size(tokenizer(text)).alias("n"))
    docs_with = F.count_if(F.col("n") > 0)
    return sized.agg(docs_with.alias("docs"), (F.sum("n") / F.nullif(docs_with, F.lit(0))).alias("avg_length"))


def document_frequency(docs: DataFrame, text: str = "text", tokenizer: Tokenizer = words) -> DataFrame:
    """(token, df). Tokens are made distinct inside a row, so counts merge map-side."""
    tokens = docs.filter(F.col(text).isNotNull()).select(F.array_distinct(tokenizer(text)).alias("tokens"))
    return _explode(tokens).groupBy("token").agg(F.count("*").alias("df"))


def inverse_frequency(frequency: DataFrame, stats: DataFrame,
                      epsilon: float = fixed.BM25_EPSILON) -> DataFrame:
    """(token, df, idf); negative values are replaced by a share of the mean."""
    docs = stats.select("docs").scalar()
    raw = frequency.select(
        "token", "df", (F.log(docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).scalar()
    idf = F.when(F.col("raw") < 0, mean * epsilon).otherwise(F.col("raw"))
    return raw.select("token", "df", idf.alias("idf"))


def vocabulary_index(docs: DataFrame, text: str = "text",
                     tokenizer: Tokenizer = words) -> tuple[DataFrame, DataFrame]:
    """Token statistics and corpus statistics, written once for many searches.

    Their size is that of the vocabulary, not of the text.
    """
    stats = cut_lineage(corpus_stats(docs, text, tokenizer))
    frequency = cut_lineage(document_frequency(docs, text, tokenizer))
    return inverse_frequency(frequency, stats), stats


def postings(counts: DataFrame, idf: DataFrame, stats: DataFrame, doc_id: str,
             k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """(token, doc_id, weight): what one query occurrence of a token adds to a document."""
    norm = F.lit(1 - b) + F.lit(b) * F.col("length") / stats.select("avg_length").scalar()
    weight = F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * norm))
    joined = counts.join(broadcast_if_small(idf.select("token", "idf")), "token")
    return joined.select("token", doc_id, weight.alias("weight"))


def query_terms(queries: DataFrame, query_id: str, text: str = "text",
                tokenizer: Tokenizer = words) -> DataFrame:
    return (
        queries.filter(F.col(text).isNotNull())
        .select(query_id, F.explode(tokenizer(text)).alias("token"))
        .groupBy(query_id, "token").agg(F.count("*").alias("qtf"))
    )


def search(docs: DataFrame, doc_id: str, queries: DataFrame, query_id: str, n: int = fixed.BM25_TOP,
           text: str = "text", query_text: str = "text", tokenizer: Tokenizer = words,
           pad: bool = False, index: tuple[DataFrame, DataFrame] | None = None,
           max_terms: int = MAX_TERMS, max_cells: int = MAX_CELLS) -> DataFrame:
    """Best ``n`` documents of every query: (query_id, doc_id, score, rank).

    Queries whose distinct terms stay within ``max_terms`` (and times queries
    within ``max_cells``) are shipped to the tasks; documents are then scored
    where they are read and each task returns at most ``n`` per query. More
    queries are joined with the postings of their tokens. Both ways give the
    same rows. Ranks follow the rounded score, then the id. ``pad`` keeps
    documents without a matching token at score zero in the order of ids.
    ``index`` is a stored :func:`vocabulary_index` of the documents.
    """
    idf, stats = index or vocabulary_index(docs, text, tokenizer)
    asked = cut_lineage(query_terms(queries, query_id, query_text, tokenizer))
    vocabulary = cut_lineage(idf.join(asked.select("token").distinct(), "token", "left_semi"))
    terms = collect_if_small(asked.join(vocabulary.select("token", "idf"), "token"), max_terms)
    cells = 0 if terms is None else len({r["token"] for r in terms}) * len({r[query_id] for r in terms})
    if terms is not None and cells <= max_cells:
        scored = _scan(docs, doc_id, text, tokenizer, terms, stats.first(), asked.schema[query_id], n)
    else:
        scored = _join(docs, doc_id, text, tokenizer, asked, vocabulary, stats, query_id)
    order = [F.desc("score"), F.col(doc_id)]
    best = top_n(scored, [query_id], order, n)
    if not pad:
        return best
    # a query short of hits is filled from the lowest ids; 2 n of them always suffice, and they travel as one value
    lowest = docs.select(doc_id).orderBy(doc_id).limit(2 * n).agg(F.collect_list(doc_id).alias("ids")).scalar()
    padded = queries.select(query_id).distinct().select(query_id, F.explode(lowest).alias(doc_id), F.lit(0.0).alias("score"))
    missing = padded.join(best, [query_id, doc_id], "left_anti")
    return top_n(best.drop("rank").unionByName(missing), [query_id], order, n)


def _join(docs, doc_id, text, tokenizer, asked, vocabulary, stats, query_id, salts: int = 16) -> DataFrame:
    """Scores of all matching pairs by a join on equal (token, salt).

    The salt spreads the postings of a very common token over many tasks. Documents are dealt
    into parts by the pairs they make, which may be many more than the rows shuffled for them.
    """
    made = asked.join(vocabulary.select("token", "df"), "token").agg(F.sum("df").alias("n")).first()["n"] or 0
    held = vocabulary.agg(F.sum("df").alias("n")).first()["n"] or 0
    all_pairs = (stats.first()["docs"] or 0) * asked.select(query_id).distinct().count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-max(held, min(made, all_pairs)) // PAIRS_AT_ONCE))
    counts = term_counts(docs, doc_id, text, tokenizer, vocabulary, parts)
    needed = postings(counts, vocabulary, stats, doc_id)
    salted = needed.withColumn("salt", F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int"))
    spread = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        salted.join(broadcast_if_small(spread), ["token", "salt"])
        .groupBy(query_id, doc_id)
        .agg((F.floor(F.sum(F.col("weight") * F.col("qtf")) * 10.0**DIGITS + 0.5) / 10.0**DIGITS).alias("score"))
        .filter(F.col("score") > 0))


def _scan(docs, doc_id, text, tokenizer, terms, totals, query_field, n: int) -> DataFrame:
    """Best ``n`` documents per query and task, scored on Arrow batches of token lists."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    schema = T.StructType([query_field, docs.schema[doc_id], T.StructField("score", T.DoubleType())])
    names = sorted({r[query_field.name] for r in terms})
    tokens = sorted({r["token"] for r in terms})
    at_query = {name: i for i, name in enumerate(names)}
    at_token = {token: i for i, token in enumerate(tokens)}
    gain = np.zeros((len(tokens), len(names)))
    for r in terms:
        gain[at_token[r["token"]], at_query[r[query_field.name]]] = r["qtf"] * r["idf"]
    mean = totals["avg_length"] or 1.0
    name_type = to_arrow_type(query_field.dataType)
    sent = docs.sparkSession.sparkContext.broadcast((tokens, gain))

    def best(ids, scores):
        order = np.lexsort((ids, -scores))[:n]
        return ids[order], scores[order]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, gain = sent.value
        known, width = pa.array(tokens, pa.string()), max(len(tokens), 1)
        step = max(1, 4_000_000 // max(gain.shape[1], 1))
        kept: dict[int, tuple] = {}
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids = np.asarray(batch.column(0).to_pylist())
            lists = batch.column(1)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            place = pc.index_in(lists.flatten(), value_set=known)
            hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(ids)), lengths)[hit]
            token = place.drop_null().to_numpy(zero_copy_only=False)
            cell, tf = np.unique(doc * width + token, return_counts=True)
            doc, token = cell // width, cell % width
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / mean))
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else doc
            # whole documents, in slices whose score matrix stays small
            first = 0
            while first < len(starts):
                last = max(first + 1, np.searchsorted(starts, starts[first] + step, side="right") - 1)
                low, high = starts[first], starts[last] if last < len(starts) else len(doc)
                score = np.floor(np.add.reduceat(
                    weight[low:high, None] * gain[token[low:high]], starts[first:last] - low, axis=0) * 10.0**DIGITS + 0.5) / 10.0**DIGITS
                own = ids[doc[starts[first:last]]]
                for q in range(gain.shape[1]):
                    column = score[:, q]
                    old = kept.get(q)
                    floor = old[1][-1] if old is not None and len(old[1]) == n else 0.0
                    rows = np.flatnonzero((column > 0) & (column >= floor))
                    if len(rows) > n:
                        edge = np.partition(column[rows], len(rows) - n)[len(rows) - n]
                        rows = rows[column[rows] >= edge]
                    if len(rows):
                        found = best(own[rows], column[rows])
                        kept[q] = found if old is None else best(
                            np.concatenate([old[0], found[0]]), np.concatenate([old[1], found[1]]))
                first = last
        for q, (found, score) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[q]] * len(found), name_type), pa.array(found.tolist(), id_type), pa.array(score)],
                names=[f.name for f in schema])

    rows = docs.filter(F.col(text).isNotNull()).select(doc_id, tokenizer(text).alias("tokens"))
    return rows.mapInArrow(scan, schema)

"""Language by fused evidence: text, declared markup language, address suffix and smoothed host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import release, slices, small_batches, stored

#: Labelled rows to learn each language from, and the bytes that are learned from a longer one.
ROWS, MOST_BYTES = 600, 16384
#: Rows that are sorted for each that is learned from.
SPARE = 4
#: Most rows to learn from whose keys are broadcast (a few MB); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1 << 17
#: Bytes of a text that are looked up at once; a longer one is taken in parts that overlap by two bytes.
AT_ONCE = 1 << 20
#: Hash buckets of byte triples.
BUCKETS = 1 << 16
#: A text counts as at most so many independent triples.
MOST_TRIPLES = 200.0
#: What no language explains better than triples that are all alike: their chance, and the chance that a text is so.
NO_TRIPLE, NO_LANGUAGE = float(-np.log(27.0**3)), 0.01
#: Chance that a page's declared language, or the language of its country's suffix, is its own.
MARKUP_TRUST, SUFFIX_TRUST = 0.9, 0.7
#: Rows of the parent that a host's or domain's own counts are smoothed with.
SMOOTHING = 10.0
#: Most hosts whose priors are broadcast; beyond it they are joined by shuffle.
BROADCAST_HOSTS = 50_000
#: Country suffixes and the language most used under them (fixed values).
SUFFIX_LANGUAGE = {
    "ar": "es", "at": "de", "au": "en", "br": "pt", "ch": "de", "cl": "es", "cn": "zh", "co": "es", "cz": "cs", "de": "de",
    "dk": "da", "es": "es", "fi": "fi", "fr": "fr", "gr": "el", "hu": "hu", "ie": "en", "it": "it", "jp": "ja", "kr": "ko",
    "mx": "es", "nl": "nl", "no": "no", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "ro": "ro", "ru": "ru", "se": "sv",
    "tr": "tr", "ua": "uk", "uk": "en", "us": "en",
}


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # languages x BUCKETS, log chance of a triple


def _triples(b: np.ndarray) -> np.ndarray:
    x = b.astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3B) + x[1:-1] * np.uint32(0x85EB) + x[2:] * np.uint32(0xC2B3)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def _text_bytes(text: str | None) -> bytes:
    """White space and case don't count; a text starts and ends with a space."""
    return b" " + b" ".join((text or "").encode().lower().split()) + b" "


def train(docs: DataFrame, rows: int = ROWS) -> Model:
    """Learns byte triples of every language of docs (doc_id, text, lang) from at most `rows` of its rows, of each its first MOST_BYTES bytes.

    Rows of least hash are taken, so a run repeats another; of a language with many rows only hashes
    under a limit that leaves SPARE times as many are sorted. Triples are counted where the texts lie. Nulls and empty texts are
    left out; without any labelled row, the one language is "und", of which every text is.
    """
    known = docs.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.substring(F.col("text").cast("binary"), 1, MOST_BYTES).alias("b")).where(F.col("lang").isNotNull() & (F.length("b") > 0))
    # a row per language; the model, which the driver holds, has 65,536 numbers of each
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("k"), F.when(F.col("n") <= SPARE * rows, 1.0).otherwise(SPARE * rows / F.col("n")).alias("share"))
    near = known.select("lang", "h").join(F.broadcast(sizes), F.col("lang") == F.col("k")).where((F.col("h") / 2.0**64 + 0.5) <= F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = near.select("lang", "h").withColumn("place", place).where(F.col("place") <= rows).select(F.col("lang").alias("l"), F.col("h").alias("g")).distinct()
    least = stored(least, "language-rows")
    few = least.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    chosen = known.join(F.broadcast(least) if few else least, (F.col("lang") == F.col("l")) & (F.col("h") == F.col("g"))).select("lang", "h", "b").distinct()

    def count(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("b").to_pylist(), strict=True):
                own = np.bincount(_triples(np.frombuffer(_text_bytes(text.decode("utf-8", "ignore")), np.uint8)), minlength=BUCKETS)
                sums[lang] = sums[lang] + own if lang in sums else own
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([own.astype("<i8").tobytes()], pa.binary())], ["lang", "counts"])

    tables: dict[str, np.ndarray] = {}
    for r in stored(chosen.select("lang", "b").mapInArrow(count, "lang string, counts binary"), "language-counts").toLocalIterator():
        tables[r.lang] = tables.get(r.lang, 0.5) + np.frombuffer(r.counts, "<i8")
    languages = sorted(tables)
    if not languages:
        return Model(["und"], np.zeros((1, BUCKETS)))
    table = np.stack([tables[x] for x in languages])
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def _sums(table: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Log likelihood of each text under each language."""
    lens = np.array([len(x) for x in texts])
    places = _triples(np.frombuffer(b"".join(texts) + b"  ", np.uint8))
    starts = np.cumsum(lens) - lens
    own = np.repeat(np.arange(len(lens)), lens)
    inside = np.arange(len(own)) < (starts + lens - 2)[own]
    return np.stack([np.bincount(own[inside], row[places[: len(own)]][inside], len(lens)) for row in table], axis=1).astype(np.float64)


def _likelihoods(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Each text's log likelihood under each language, and last under none, less the greatest; zeros for a text without a letter or sign."""
    made = [_text_bytes(t) for t in texts]
    lens = np.array([len(x) for x in made])
    sums = _sums(table, [x if len(x) <= AT_ONCE else b"" for x in made])
    for i in np.flatnonzero(lens > AT_ONCE).tolist():
        x = made[i]
        sums[i] = sum(_sums(table, [x[at : at + AT_ONCE + 2]])[0] for at in range(0, len(x) - 2, AT_ONCE))
    n = np.maximum(1, lens - 2)
    sums = np.column_stack([sums, n * NO_TRIPLE])
    sums *= (MOST_TRIPLES / (MOST_TRIPLES + n))[:, None]
    sums -= sums.max(axis=1, keepdims=True)
    sums[lens <= 2] = 0
    return sums


def text_likelihoods(rows: DataFrame, model: Model, text: str = "text", name: str = "likelihood") -> DataFrame:
    """Adds (or replaces) `name`: an array of the text's log likelihood under each language, and last under none, less the greatest, or zeros for a text of white space alone. Whole texts, no shuffle."""
    kept = [c for c in rows.columns if c != name]
    rows = rows.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, text, 1 << 20):
            sums = _likelihoods(b.column(text).to_pylist(), model.table)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sums.tolist(), pa.list_(pa.float64()))], [*kept, name])

    return rows.mapInArrow(run, rows.withColumn(name, F.array(F.lit(0.0))).schema)


def visible_text(html: Column) -> Column:
    """The text between the tags of a page, without scripts and styles."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")


def declared_language(html: Column) -> Column:
    """The main part of the lang attribute of the html tag, or an empty string."""
    return F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([a-z]+)""", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two parts of a host's name; null for a name of one part."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    """The last part of a host's name; null for a name of one part, which isn't an address."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def _normal(x: np.ndarray) -> np.ndarray:
    """Rows of logs to chances."""
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(-1, width)


def _declared(values: list[str | None], languages: list[str], trust: float) -> tuple[np.ndarray, np.ndarray]:
    """Log chances of declared values under each language, and last under none, zeros where it is none of them; and where it is one."""
    n, place = len(languages), {x: i for i, x in enumerate(languages)}
    at = np.array([place.get(v, -1) for v in values])
    out = np.zeros((len(at), n + 1))
    known = at >= 0
    out[known, :n] = np.log((1 - trust) / (n - 1)) if n > 1 else -30.0
    out[known, n] = -np.log(n)
    out[known, at[known]] = np.log(trust)
    return out, known


def identify(rows: DataFrame, model: Model, text: str = "text", markup: Column | None = None, host: Column | None = None, name: str = "language", keep: list[str] | None = None) -> DataFrame:
    """Adds (or replaces) `language`, `posterior` and `language_kept`.

    Log likelihoods of text, declared language and country suffix of the host are summed with the log
    of the host's prior. Priors come from grouped sums of what the texts alone say of all other rows: a
    row's own share is taken out of its host's, its domain's and the table's sums; a host's sums are
    smoothed by its domain's, those by the table's. Hosts of one part (a source's name) have neither
    domain nor suffix; rows without a host take the table's prior. Texts that no language explains
    better than even triples count as of no language, which has a fixed prior of NO_LANGUAGE.

    posterior is the chance among the languages. The result is kept if it is 0.5 or more, if no language
    at all is less likely than 0.5, and if the row has any evidence of its own: a letter in the text, a
    known declared language or a known suffix. Null and empty texts are rows without
    text evidence; a very long text is summed in parts; repeated rows are judged alike; ties go to the
    language first in the alphabet; an empty table gives an empty one. Columns of rows (or those of
    `keep`) may have any names. Where the text isn't kept, each is scored once, and kept columns and
    likelihoods are written to the shared folder; where it is, it is scored twice, for the sums and for
    the result, as that costs less than another copy of the corpus. Priors of up to BROADCAST_HOSTS hosts are broadcast; more are joined by shuffle,
    where Spark splits hosts of many rows.
    """
    n, langs = len(model.languages), model.languages
    out = (name, "posterior", f"{name}_kept")
    kept = [c for c in (rows.columns if keep is None else keep) if c not in out]
    none = F.lit(None).cast("string")
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    said = f"c{kept.index(text)}" if text in kept else "text"
    h = host if host is not None else none
    base = rows.select(*held, *([] if text in kept else [F.col(f"`{text}`").alias("text")]), F.when(h != "", h).alias("host"), (markup if markup is not None else none).alias("markup"))
    base = base.withColumn("letters", F.coalesce(F.col(said).rlike(r"\p{L}"), F.lit(False)))
    passed = [c for c in base.columns if c != "text"]

    def says(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """What texts say, and their chances without the share of no language; nothing without a letter."""
        letters = np.asarray(b.column("letters").to_pylist(), bool)
        logs = _likelihoods(b.column(said).to_pylist(), model.table) * letters[:, None]
        return logs, _normal(logs)[:, :n] * letters[:, None]

    def score(columns: list[str]):
        def run(batches: Iterator[pa.RecordBatch]):
            for b in slices(batches, said, 1 << 20):
                lists = [pa.array(x.tolist(), pa.list_(pa.float64())) for x in says(b)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *lists], [*columns, "said", "own"])
            release()

        return run

    none_yet = F.array(F.lit(0.0))
    small_batches(base.sparkSession)
    again = text in kept
    # a worker's rows go back to Spark whole, so the sums get no column besides their host
    sent = ["host"] if again else passed
    scored = base.select(said, "letters", "host") if again else base
    scored = scored.mapInArrow(score(sent), base.select(*sent, none_yet.alias("said"), none_yet.alias("own")).schema)
    if not again:
        scored = stored(scored, "language-texts")
    add = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    hosts = stored(scored.groupBy("host").agg(add("own").alias("sums")).withColumn("domain", domain_of(F.col("host"))), "language-hosts")
    whole = hosts.agg(add("sums").alias("sums")).collect()[0][0]
    whole = np.array([x or 0.0 for x in whole or [0.0] * n])
    domains = hosts.where("domain is not null").groupBy(F.col("domain").alias("d")).agg(add("sums").alias("domain_sums"))
    priors = hosts.where("host is not null").join(domains, F.col("domain") == F.col("d"), "left").select(F.col("host").alias("key"), F.col("sums").alias("host_sums"), "domain_sums")
    few = priors.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    country = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])[F.coalesce(suffix_of(F.col("host")), F.lit(""))]
    joined = (base if again else scored).withColumn("country", country).join(F.broadcast(priors) if few else priors, F.col("host") == F.col("key"), "left").drop("host", "key")

    def fuse(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, said, 1 << 20) if again else batches:
            logs, own = says(b) if again else (_matrix(b.column("said"), n + 1), _matrix(b.column("own"), n))
            prior = np.maximum(whole - own, 0.0) + 1.0
            prior /= prior.sum(axis=1, keepdims=True)
            for c in ("domain_sums", "host_sums"):
                held = np.flatnonzero(np.asarray(b.column(c).is_valid()))
                sums = _matrix(b.column(c).drop_null(), n) - own[held]
                prior[held] = (np.maximum(sums, 0.0) + SMOOTHING * prior[held]) / (sums.sum(axis=1) + SMOOTHING)[:, None]
            marked, known = _declared(b.column("markup").to_pylist(), langs, MARKUP_TRUST)
            placed, named = _declared(b.column("country").to_pylist(), langs, SUFFIX_TRUST)
            fused = np.column_stack([np.log(prior * (1 - NO_LANGUAGE)), np.full(len(prior), np.log(NO_LANGUAGE))]) + logs + marked + placed
            chances = _normal(fused)
            best = chances[:, :n].argmax(axis=1)
            posterior = chances[np.arange(len(best)), best] / chances[:, :n].sum(axis=1)
            sure = (posterior >= 0.5) & (chances[:, n] < 0.5) & (np.asarray(b.column("letters").to_pylist(), bool) | known | named)
            yield pa.RecordBatch.from_arrays([*(b.column(f"c{i}") for i in range(len(kept))), pa.array([langs[i] for i in best.tolist()], pa.string()), pa.array(posterior), pa.array(sure)], [*(f"c{i}" for i in range(len(kept))), "language", "posterior", "kept"])
        release()

    small = joined.select(*(f"c{i}" for i in range(len(kept))), "letters", *([] if again else ["said", "own"]), "markup", "country", "host_sums", "domain_sums")
    shape = rows.select(*held).withColumn("language", F.lit("")).withColumn("posterior", F.lit(0.0)).withColumn("kept", F.lit(True)).schema
    best = small.mapInArrow(fuse, shape)
    return best.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("language").alias(name), "posterior", F.col("kept").alias(f"{name}_kept"))

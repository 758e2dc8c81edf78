"""Text audits: normalisation, quotes, entities, links, fuzzy names."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Quotes that one pass over the documents looks for, in bytes of text; more are looked for in several passes.
QUOTE_BYTES = 16 << 20
#: Documents in which quotes are looked up at once, bits of a bitmap of runs, and an odd number that mixes hashes.
AT_ONCE, BITS, MIX = 64, 20, np.uint64(0x9E3779B97F4A7C15)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def normalised(text: Column) -> Column:
    """NFKC; quotes, dashes and no-break spaces folded; words that a line break cuts joined; white space single; trimmed."""
    t = F.regexp_replace(nfkc(text), "[‘’]", "'")
    t = F.regexp_replace(t, "[“”]", '"')
    t = F.regexp_replace(t, "[‐-―]", "-")
    t = F.regexp_replace(t, "-(?U)\\s*\n\\s*", "")
    return F.trim(F.regexp_replace(t, "(?U)\\s+", " "))


def words_alone(text: Column) -> Column:
    """The normalised text in small letters, with a space at both ends, so that whole words are found by their spaces."""
    return F.concat(F.lit(" "), F.lower(normalised(text)), F.lit(" "))


def doubled(h: np.ndarray, n: int) -> np.ndarray:
    """From hashes of runs of n words those of runs of 2 n."""
    x = h[:-n] * MIX + h[n:]
    return (x ^ (x >> np.uint64(29))) * MIX


class Quotes:
    """Distinct quotes (words by single spaces, a space at both ends) by hashes of their first and last 2 ** k words, the most there are.

    These two runs cover a quote, so that a look-up takes no longer for quotes that begin alike. Hashes are the process's own.
    """

    def __init__(self, quotes: list[str]):
        self.quotes, by_length = quotes, {}
        for i, q in enumerate(quotes):
            by_length.setdefault(q.count(" ") - 1, []).append(i)
        self.levels: dict[int, tuple[np.ndarray, list]] = {}  # by k: a bitmap of first runs, and for each length its keys and quotes
        for length, own in sorted(by_length.items()):
            k = length.bit_length() - 1
            h = self.hashes(quotes[i] for i in own).reshape(-1, length + 1)[:, :length].T  # a column for each quote
            for n in range(k):
                h = doubled(h, 1 << n)
            keys = self.key(h[0], h[-1])
            order = keys.argsort(kind="stable")
            bits, lengths = self.levels.setdefault(k, (np.zeros(1 << BITS, bool), []))
            bits[h[0] >> np.uint64(64 - BITS)] = True
            lengths.append((length, keys[order], np.array(own)[order]))

    @staticmethod
    def hashes(texts) -> np.ndarray:
        """Hashes of the words of all texts, a space's behind each text."""
        words: list[str] = []
        for t in texts:
            words += t[1:-1].split(" ")
            words.append(" ")
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    @staticmethod
    def key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (first ^ (first >> np.uint64(31))) * MIX + last

    def found(self, texts: list[str]) -> list[tuple[int, int]]:
        """(quote, text) by their numbers, each once, wherever a quote stands in a text."""
        h, out = self.hashes(texts), set()
        ends = np.cumsum([t.count(" ") if len(t) > 2 else 2 for t in texts])
        for k in range(max(self.levels, default=-1) + 1):
            if k:
                if len(h) <= 1 << (k - 1):
                    break
                h = doubled(h, 1 << (k - 1))
            if k not in self.levels:
                continue
            bits, lengths = self.levels[k]
            at = np.flatnonzero(bits[h >> np.uint64(64 - BITS)])
            for length, keys, own in lengths if len(at) else ():
                fits = at[at + length - (1 << k) < len(h)]
                mine = self.key(h[fits], h[fits + length - (1 << k)])
                low = keys.searchsorted(mine)
                hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == mine)
                for place, low_, key in zip(ends.searchsorted(fits[hit], "right").tolist(), low[hit].tolist(), mine[hit].tolist(), strict=True):
                    while low_ < len(keys) and int(keys[low_]) == key:
                        out.add((int(own[low_]), place))
                        low_ += 1
        return [(q, t) for q, t in out if self.quotes[q] in texts[t]]


def quoted(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """item_id, doc_id of quotes (item_id, text) of any length that stand word for word in a document, both normalised.

    Every document is read once, its runs of words looked up among the quotes'; nothing moves. Quotes of more than QUOTE_BYTES
    are dealt to as many passes, so a task holds no more of them. A quote without words stands nowhere.
    """
    q = quotes.select("item_id", words_alone(F.col("text")).alias("quote")).where("length(trim(quote)) > 0")
    size = q.agg(F.coalesce(F.sum(F.octet_length("quote")), F.lit(0)).alias("n")).first().n
    d, passes = documents.select("doc_id", words_alone(F.col("text")).alias("whole")).where("whole IS NOT NULL"), max(1, -(-size // QUOTE_BYTES))
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((quotes, "item_id"), (documents, "doc_id"))}
    out = []
    for k in range(passes):
        own: dict[str, list] = {}
        for r in q.where(F.pmod(F.xxhash64("quote"), F.lit(passes)) == k).collect():
            own.setdefault(r.quote, []).append(r.item_id)
        sent = documents.sparkSession.sparkContext.broadcast((list(own), list(own.values())))

        def find(batches, sent=sent):
            texts, items = sent.value
            index = Quotes(texts)
            for pdf in batches:
                for start in range(0, len(pdf), AT_ONCE):
                    part = pdf.iloc[start : start + AT_ONCE]
                    ids = part.doc_id.tolist()
                    rows = [(i, ids[t]) for n, t in index.found(part.whole.tolist()) for i in items[n]]
                    yield pd.DataFrame(rows, columns=["item_id", "doc_id"])

        out.append(d.mapInPandas(find, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}"))
    found = out[0]
    for other in out[1:]:
        found = found.unionByName(other)
    return found.distinct()


def divergence(quote: Column, text: Column, window: int = 120) -> Column:
    """Where a text stops to agree with a quote: the length of the quote's longest start that stands in the text, and how
    both go on from there (null for the text if no start does)."""
    lengths = F.filter(F.sequence(F.lit(0), F.length(quote)), lambda n: F.instr(text, F.substr(quote, F.lit(1), n)) > 0)
    n = F.coalesce(F.array_max(F.when(F.length(quote) > 0, lengths)), F.lit(0))
    at = F.instr(text, F.substr(quote, F.lit(1), n))
    return F.struct(n.alias("agrees"), F.substr(quote, n + 1, F.lit(window)).alias("quote_goes_on"), F.when(n > 0, F.substr(text, at + n, F.lit(window))).alias("text_goes_on"))


def entities(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1)


def link_class(status: Column, secure: Column) -> Column:
    return F.when(status.isNull(), "unreached").when(status.between(200, 299) & secure, "ok").when(status.between(200, 399), "moved").when(status.isin(401, 403, 429), "refused").otherwise("broken")


def letters(name: Column) -> Column:
    """Letters and digits alone, small."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def fuzzy(guesses: DataFrame, names: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """guess, name, how: the same, the same but for case, or the most similar name (1 - edits / longer length, of
    letters and digits alone) at cutoff or above; of equal ones the first.

    A name that so few edits turn into a guess keeps at least one of its pieces: it is cut into one piece more than there
    may be edits, and the guess is asked for each where it may stand. So only names with a piece in common are compared.
    """
    g = guesses.select("guess").distinct().withColumn("g", letters(F.col("guess"))).withColumn("m", F.length("g"))
    n = names.select("name").distinct().withColumn("n", letters(F.col("name"))).withColumn("len", F.length("n"))
    edits = F.floor(F.ceil(F.col("len") / cutoff) * (1 - cutoff) + 1e-9).cast("int")
    start = lambda i: F.floor(i * F.col("len") / (F.col("edits") + 1)).cast("int")
    pieces = n.withColumn("edits", edits).withColumn("i", F.explode(F.sequence(F.lit(0), "edits")))
    pieces = pieces.select("name", "n", "len", "i", F.substr("n", start(F.col("i")) + 1, start(F.col("i") + 1) - start(F.col("i"))).alias("piece"))
    asked = g.withColumn("len", F.explode(F.sequence(F.floor(F.col("m") * cutoff).cast("int"), F.ceil(F.col("m") / cutoff).cast("int")))).where("len > 0")
    asked = asked.withColumn("edits", edits).withColumn("i", F.explode(F.sequence(F.lit(0), "edits"))).withColumn("shift", F.explode(F.sequence(-F.col("edits"), F.col("edits"))))
    asked = asked.withColumn("at", start(F.col("i")) + F.col("shift")).where("at >= 0 AND at <= m")
    asked = asked.select("guess", "g", "m", "len", "i", F.substr("g", F.col("at") + 1, start(F.col("i") + 1) - start(F.col("i"))).alias("piece")).distinct()
    near = asked.join(pieces, ["len", "i", "piece"]).select("guess", "g", "m", "name", "n", "len").distinct()
    like = 1 - F.levenshtein("g", "n") / F.greatest("m", "len")
    named = near.select("guess", "name", F.lit("similar").alias("how"), like.alias("like"))
    same = g.join(n.select("name", F.lower("name").alias("k")), F.lower(F.col("guess")) == F.col("k"))
    exact = F.col("guess") == F.col("name")
    named = named.unionByName(same.select("guess", "name", F.when(exact, "exact").otherwise("case").alias("how"), F.when(exact, 3.0).otherwise(2.0).alias("like")))
    best = named.where(F.col("like") >= cutoff - 1e-12).withColumn("n", F.row_number().over(Window.partitionBy("guess").orderBy(F.desc("like"), "name"))).where("n = 1")
    return g.select("guess").join(best.select("guess", "name", "how"), "guess", "left")


def without_page_numbers(pages: DataFrame) -> DataFrame:
    """key, page, body: lines that are a page number alone go; one glued to the first line goes only where
    the page before ends within a sentence. pages: key, page, text."""
    w = Window.partitionBy("key").orderBy("page")
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike("^ *[0-9]{1,4} *$"))
    body = F.array_join(lines, "\n")
    out = pages.withColumn("body", body).withColumn("before", F.lag("body").over(w))
    open_end = F.col("before").isNotNull() & ~F.col("before").rlike("[.!?:] *$")
    return out.select("key", "page", F.when(open_end, F.regexp_replace("body", "^[0-9]{1,4}(?=[A-Za-z])", "")).otherwise(F.col("body")).alias("body"))


def named_classes(classes: DataFrame, word: str = "fault", extra: tuple[str, ...] = ()) -> DataFrame:
    """Classes (id, name) whose name contains the word, in any case, or is one of the extra names."""
    return classes.where(F.lower("name").contains(word.lower()) | F.col("name").isin(*extra)) if extra else classes.where(F.lower("name").contains(word.lower()))


def bad_dates(rows: DataFrame, column: str, today: Column | None = None) -> DataFrame:
    """Rows whose text is no ISO date, or one still to come."""
    day = F.try_to_date(column, "yyyy-MM-dd")
    return rows.where(day.isNull() | (day > (F.current_date() if today is None else today)))


def policy(name: Column) -> tuple[Column, Column]:
    """Floor and width that a policy's name tells, null where it does not."""
    t, w = (F.regexp_extract(name, "t0_([0-9.]+)_width([0-9]+)px", i) for i in (1, 2))
    return F.when(t != "", t.cast("double")), F.when(w != "", w.cast("int"))


def json_first(doc: Column, paths: list[str]) -> Column:
    """The value at the first of paths that a JSON document has, as text; null if it has none or is no JSON."""
    return F.coalesce(*[F.get_json_object(doc, p) for p in paths])


def link_audit(pages: DataFrame, hosts: list[str]) -> DataFrame:
    """page_id, href, problem of links in pages (page_id, url, html): another host (none of hosts, nor below one), or no
    page (a local link whose path no page's url has)."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#?]*)'), F.lit(1))).alias("href")).distinct()
    own = host(F.col("href"))
    known = F.lit(False)
    for h in hosts:
        known = known | (own == h) | own.endswith("." + h)
    away = links.where((own != "") & ~known).withColumn("problem", F.lit("another host"))
    paths = pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("href")).distinct()
    local = links.where(F.col("href").startswith("/")).join(paths, "href", "left_anti").select("page_id", "href").withColumn("problem", F.lit("no page"))
    return away.unionByName(local)


#: Letters that recognition gives for digits, and the digits.
READ_WRONG, READ_RIGHT = "OolIS", "00115"


def repaired_addresses(documents: DataFrame) -> DataFrame:
    """source, found, repaired, rejected: things like four numbers between dots in documents (source, text), those of them
    that are addresses only after letters were put right, and those that still are none (a number above 255)."""
    like = "[.]".join(["[0-9OolIS]{1,3}"] * 4)
    each = documents.select("source", F.explode(entities(F.col("text"), like)).alias("raw"))
    each = each.withColumn("fine", F.translate("raw", READ_WRONG, READ_RIGHT))
    good = F.forall(F.split("fine", "[.]"), lambda x: x.cast("int") <= 255)
    return each.groupBy("source").agg(F.count("*").alias("found"), F.count_if(good & (F.col("raw") != F.col("fine"))).alias("repaired"), F.count_if(~good).alias("rejected"))


def class_ids(seen: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """class, id: the vocabulary (class, id) as it is, and classes of seen (class, at) that it lacks, numbered after it in the
    order in which they are first seen, then by name. Their number is that of classes, not of rows."""
    new = seen.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("at").alias("at")).join(vocabulary, "class", "left_anti")
    last = vocabulary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = new.crossJoin(F.broadcast(last)).select("class", (F.col("last") + F.row_number().over(Window.orderBy("at", "class"))).cast("int").alias("id"))
    return vocabulary.select("class", F.col("id").cast("int").alias("id")).unionByName(numbered)

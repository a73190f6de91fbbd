"""Content moderation: decode, two keyword tiers, verdicts, images, decisions, cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from watchfold import constants as K
from watchfold.functions import levels as L
from watchfold.functions.hashing import hmac_sha256, sha256
from watchfold.functions.jsontext import is_one_json, json_list, json_scalar, spaced_object, uuid_form
from watchfold.functions.text import WORD_CLASS, is_blank, tokens, word_regex
from watchfold.schemas import MESSAGE
from watchfold.session import shared_dir

# --- messages ------------------------------------------------------------------


def decode_messages(
    df: DataFrame, kind: str, body: str, now: Column, full: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(messages, undecodable rows) from pushed events.

    ``body`` is JSON text holding ``message``; events of another kind than
    message-created are dropped.  ``full`` (message_name, sender, text) fills in
    an empty text or sender.
    """
    schema = f"message {StructType.fromDDL(MESSAGE).simpleString()}, __bad STRING"
    parsed = df.where(F.col(kind) == K.MESSAGE_CREATED).withColumn(
        "__e", F.from_json(body, schema, {"columnNameOfCorruptRecord": "__bad"})
    )
    broken = F.col("__e").isNull() | F.col("__e.__bad").isNotNull() | ~is_one_json(F.col(body))
    bad = parsed.where(broken).drop("__e")
    m = parsed.where(~broken).select(F.col("__e.message").alias("m"))

    def filled(*cols: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])

    name = F.coalesce("m.name", F.lit(""))
    created = F.try_to_timestamp("m.createTime")
    good = m.select(
        name.alias("message_name"),
        F.substring_index(name, "/", 2).alias("space_name"),
        filled("m.sender.email", "m.sender.name").alias("sender"),
        filled("m.text", "m.argumentText").alias("text"),
        F.coalesce(created, now).alias("received_at_utc"),
        F.col("m.attachment").alias("attachment"),
    )
    if full is not None:
        more = full.groupBy("message_name").agg(F.min(F.struct(F.col("sender").alias("s"), F.col("text").alias("t"))).alias("__m")).select(
            "message_name", F.col("__m.s").alias("__s"), F.col("__m.t").alias("__t")
        )
        good = good.join(more, "message_name", "left").withColumns(
            {"sender": F.coalesce("sender", "__s"), "text": F.coalesce("text", "__t")}
        ).drop("__s", "__t")
    return good, bad


def resolve_sender(msgs: DataFrame, directory: DataFrame) -> DataFrame:
    """Replace a user reference by its directory e-mail; an unknown one stays."""
    # a person listed twice must not double the messages; the least address wins
    known = directory.groupBy(F.col("user_id").alias("__u")).agg(F.min("email").alias("__email"))
    ref = F.when(~F.contains("sender", F.lit("@")), F.element_at(F.split("sender", "/"), -1))
    return (
        msgs.withColumn("__ref", ref)
        .join(known, F.col("__ref") == F.col("__u"), "left")
        .withColumn("sender_email", F.coalesce("__email", "sender"))
        .drop("__ref", "__u", "__email")
    )


# --- keyword tiers ---------------------------------------------------------------

RARE_FROM = 16  # one text in so many is counted to find a term's rarest piece
PLAIN_WORD = f"^[{WORD_CLASS}]+$"


class Term(NamedTuple):
    tier: str
    term: str
    kind: str


def scan_words(low: Column, words: Sequence[str]) -> Column:
    """Words found in a lower-case text, in list order.

    ``low`` should be a column of its own: it is read once per word.

    Words made of word characters only are whole tokens, so the text is cut once and intersected.
    Any other word is searched: a plain substring search first, and the boundaries only where it hits.
    """

    def searched(word: str) -> Column:
        return F.when(F.contains(low, F.lit(word)) & low.rlike(word_regex(word)), F.lit(word))

    if not words:
        return _strings([])
    plain = [w for w in words if all(c == "_" or c.isalnum() for c in w)]
    odd = [w for w in words if w not in set(plain)]
    found = F.array_intersect(_strings(plain), tokens(low))
    if not odd:
        return found
    other = F.array_compact(F.array(*[searched(w) for w in odd]))
    # back to list order
    return F.array_intersect(_strings(words), F.concat(found, other))


def scan_phrases(low: Column, phrases: Sequence[str]) -> Column:
    """Phrases contained in a lower-case text, in list order."""
    if not phrases:
        return _strings([])
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases]))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def keyword_scan(df: DataFrame, text: str, terms: DataFrame | Sequence[Term], id_col: str) -> DataFrame:
    """Adds ``hard_terms``, ``soft_terms`` and ``all_terms`` (no repeats, hard first).

    A list of ``Term`` is written into the plan and needs no shuffle.  A table (tier, ord, term, kind) of any size is
    joined, each term by the segments that hold its rarest part; the plan is the same whatever its size.  The segments are worked
    out at once and written to the shared folder.
    """
    if isinstance(terms, DataFrame):
        return _scan_by_rarest_segment(df, text, terms, id_col)

    def of(tier: str) -> Column:
        words = list(dict.fromkeys(t.term for t in terms if t.tier == tier and t.kind == "word"))
        phrases = list(dict.fromkeys(t.term for t in terms if t.tier == tier and t.kind == "phrase"))
        return F.concat(scan_words(F.col("__low"), words), scan_phrases(F.col("__low"), phrases))

    return (
        df.withColumn("__low", F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumns({"hard_terms": of("hard"), "soft_terms": of("soft")})
        .withColumn("all_terms", F.array_distinct(F.concat("hard_terms", "soft_terms")))
        .drop("__low")
    )


def _runs_of_three(text: Column) -> Column:
    """The distinct runs of three characters."""
    cut = lambda t: F.regexp_extract_all(t, F.lit("(?s).{3}"), F.lit(0))
    return F.array_distinct(F.concat(cut(text), cut(F.substring(text, 2, 2**31 - 1)), cut(F.substring(text, 3, 2**31 - 1))))


def text_pieces(texts: DataFrame, low: str) -> DataFrame:
    """``texts`` once for each piece a term may be found by in the lower-case column ``low``, without that column.

    Pieces are the text's distinct tokens of four characters or more, and its distinct runs of one to three characters.
    """
    of_size = lambda x, n: F.filter(x, lambda p: F.length(p) == n)
    end = lambda n: of_size(F.array(F.right(low, F.lit(n))), n)
    heads = lambda c, n: F.transform(c, lambda p: F.substring(p, 1, n))
    # Each column is used twice, so each is made once.  Any two neighbours begin a run of three but for the text's last ones.
    cut = texts.withColumn("__three", _runs_of_three(F.col(low)))
    cut = cut.withColumn("__two", F.array_distinct(F.concat(heads("__three", 2), end(2))))
    cut = cut.withColumn("__one", F.array_distinct(F.concat(heads("__two", 1), end(1))))
    words = F.array_distinct(F.filter(tokens(F.col(low)), lambda t: F.length(t) > 3))
    kept = [c for c in texts.columns if c != low]
    return cut.select(*kept, F.explode(F.concat(words, "__three", "__two", "__one")).alias("piece"))


def _word_pattern(term: Column) -> Column:
    """The same pattern as functions.text.word_regex, from a column."""
    quoted = F.regexp_replace(term, r"([^\p{L}\p{N}_\s])", r"\\$1")
    word = f"[{WORD_CLASS}]"
    left = F.when(F.substring(term, 1, 1).rlike(word), f"(?<!{word}").otherwise(f"(?<={word}")
    right = F.when(F.right(term, F.lit(1)).rlike(word), f"(?!{word})").otherwise(f"(?={word})")
    return F.concat(quoted, left, quoted, F.lit(")"), right)


def term_pieces(terms: DataFrame) -> DataFrame:
    """(tier, kind, ord, term, re, piece): each piece that every text holding the term must have.

    A word of four word characters or more is one token and nothing else; ``re`` is null then.
    Any other word has a pattern for its boundaries, a phrase an empty one.
    """
    plain = F.col("term").rlike(f"^[{WORD_CLASS}]{{4,}}$") & (F.col("kind") == "word")
    pattern = F.when(F.col("kind") == "word", _word_pattern(F.col("term"))).otherwise("")
    runs = F.when(F.length("term") >= 3, _runs_of_three(F.col("term"))).otherwise(F.array("term"))
    pieces = F.when(plain, F.array("term")).otherwise(runs)
    return terms.where(F.length("term") > 0).select("tier", "kind", "ord", "term", F.when(~plain, pattern).alias("re"), F.explode(pieces).alias("piece"))


def rarest_pieces(texts: DataFrame, low: str, terms: DataFrame, one_in: int = RARE_FROM) -> DataFrame:
    """(tier, kind, ord, term, re, piece): of each term's pieces the one that the fewest ``texts`` hold.

    One text in ``one_in``, chosen by hash, is counted: the choice decides how many texts are searched, never what is found.
    """
    pieces = term_pieces(terms)
    wanted = pieces.select("piece").distinct()
    held = text_pieces(texts.where(F.pmod(F.xxhash64(low), F.lit(one_in)) == 0).select(low), low)
    often = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).join(wanted, "piece", "left_semi")
    rated = pieces.join(often, "piece", "left").select("tier", "kind", "ord", "term", "re", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece").alias("p"))
    best = rated.groupBy("tier", "kind", "ord", "term", "re").agg(F.min("p").alias("p"))
    return best.select("tier", "kind", "ord", "term", "re", F.col("p.piece").alias("piece"))


def text_segments(texts: DataFrame, low: str, parts: DataFrame) -> DataFrame:
    """``texts`` once for each of its distinct segments, without the lower-case column ``low``.

    Segments are the maximal runs of word characters and, if any of ``parts`` is without word characters, those between them.
    """
    asked = parts.agg(F.coalesce(F.bool_or(~F.col("part").rlike(PLAIN_WORD)), F.lit(False)).alias("__asked"))
    between = F.when(F.col("__asked"), F.split(low, f"[{WORD_CLASS}]+")).otherwise(_strings([]))
    cut = F.array_remove(F.array_distinct(F.concat(tokens(F.col(low)), between)), "")
    kept = [c for c in texts.columns if c != low]
    return texts.crossJoin(F.broadcast(asked)).select(*kept, F.explode(cut).alias("segment"))


def term_parts(terms: DataFrame) -> DataFrame:
    """(tier, kind, ord, term, re, part, starts, ends): the segments of each term, but a blank beside others.

    A text that holds the term has, for each part, a segment that holds the part: one that begins with it if ``starts``,
    ends with it if ``ends``, and is it if both.  ``re`` is null for a word that is one token, a pattern for other
    words, empty for a phrase.
    """
    word = F.col("kind") == "word"
    pattern = F.when(word, _word_pattern(F.col("term"))).otherwise("")
    in_order = F.regexp_extract_all("term", F.lit(f"[{WORD_CLASS}]+|[^{WORD_CLASS}]+"), F.lit(0))
    parts = terms.where(F.length("term") > 0).select(
        "tier", "kind", "ord", "term", F.when(~(word & F.col("term").rlike(PLAIN_WORD)), pattern).alias("re"), in_order.alias("__parts")
    )
    parts = parts.select("*", F.posexplode("__parts").alias("__at", "part")).where((F.size("__parts") == 1) | (F.col("part") != " "))
    starts, ends = word | (F.col("__at") > 0), word | (F.col("__at") < F.size("__parts") - 1)
    return parts.select("tier", "kind", "ord", "term", "re", "part", F.coalesce(starts, F.lit(False)).alias("starts"), F.coalesce(ends, F.lit(False)).alias("ends"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """The table by way of the shared folder: made once, and of a size that Spark knows when it chooses how to join."""
    folder = shared_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def segment_terms(texts: DataFrame, low: str, parts: DataFrame) -> DataFrame:
    """(segment, tier, kind, ord, term, re): each term by the segments that hold the one of its ``parts`` that the fewest texts hold.

    The texts are cut once, into segments.  Only the distinct segments, which are far fewer than those of all texts, are
    cut further and searched for the parts.
    """
    segments = text_segments(texts.select(low), low, parts).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    segments = _written(segments, "segments")
    how = ["part", "starts", "ends"]
    whole = F.col("starts") & F.col("ends")
    # each part once, as a term of its own that is looked for in the segments
    asked = parts.select(*how).distinct().select(
        F.concat_ws(",", "starts", "ends").alias("tier"), F.when(whole, "word").otherwise("phrase").alias("kind"), F.lit(0).alias("ord"), F.col("part").alias("term")
    )
    index = rarest_pieces(segments, "segment", asked).select(
        F.col("term").alias("part"), F.col("tier").startswith("true").alias("starts"), F.col("tier").endswith("true").alias("ends"), "piece"
    )
    index = _written(index, "part-pieces")
    fits = (
        F.when(whole, F.col("segment") == F.col("part"))
        .when(F.col("starts"), F.startswith("segment", "part"))
        .when(F.col("ends"), F.endswith("segment", "part"))
        .otherwise(F.contains("segment", "part"))
    )
    held = text_pieces(segments.withColumn("__cut", F.col("segment")), "__cut").join(index, "piece").where(fits).drop("piece")
    held = _written(held, "segments-held")

    # a part that no segment holds is the rarest: its term is in no text and joins nothing
    rated = parts.join(held.groupBy(*how).agg(F.sum("n").alias("n")), how, "left")
    best = rated.groupBy("tier", "kind", "ord", "term", "re").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), *how)).alias("p"))
    best = best.select("tier", "kind", "ord", "term", "re", *[F.col(f"p.{c}").alias(c) for c in how])
    return held.drop("n").join(best, how).drop(*how)


def _scan_by_rarest_segment(df: DataFrame, text: str, terms: DataFrame, id_col: str) -> DataFrame:
    """Keyword scan against a term table of any size.

    Texts are cut into their distinct segments; each term is joined on the segments that hold its rarest part, and the texts it may
    be in are then searched for it.  So terms that begin alike, or are made of frequent parts but for one, do not
    meet the texts that only share those.
    """
    low = df.select(id_col, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__low"))
    parts = term_parts(terms)
    index = _written(segment_terms(low, "__low", parts), "segment-terms")
    found = text_segments(low, "__low", parts).join(index, "segment")
    # The terms a text may hold; only these rows are shuffled, and the text meets them once to check those not certain yet.
    candidate = F.struct(
        F.when(F.col("tier") == "hard", 0).otherwise(1).alias("t"), F.when(F.col("kind") == "word", 0).otherwise(1).alias("k"), "ord", "term", "re"
    )
    per_text = found.groupBy(F.col(id_col).alias("__i")).agg(F.array_sort(F.collect_set(candidate)).alias("__f"))
    body = F.lower(F.coalesce(F.col(text), F.lit("")))

    def holds(s: Column) -> Column:
        phrase = F.contains(F.col("__body"), s["term"])
        return F.when(s["re"].isNull(), True).when(s["k"] == 1, phrase).otherwise(F.rlike(F.col("__body"), s["re"]))

    def of(tier: int) -> Column:
        kept = F.filter("__f", lambda s: s["t"] == tier)
        return F.coalesce(F.array_distinct(F.transform(kept, lambda s: s["term"])), _strings([]))

    return (
        df.join(per_text, F.col(id_col) == F.col("__i"), "left")
        .withColumn("__body", F.when(F.col("__f").isNotNull(), body))
        .withColumn("__f", F.filter("__f", holds))
        .withColumns({"hard_terms": of(0), "soft_terms": of(1)})
        .withColumn("all_terms", F.array_distinct(F.concat("hard_terms", "soft_terms")))
        .drop("__f", "__body", "__i")
    )


# --- second stage and text verdict ---------------------------------------------


def parse_verdict(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``verdict`` and ``rationale``; what cannot be read counts as true positive."""
    doc = F.from_json(raw, "verdict STRING, rationale STRING, __bad STRING", {
        "columnNameOfCorruptRecord": "__bad", "allowSingleQuotes": "false",
    })
    # nothing may follow the object, and no key may come twice: what a strict reader refuses counts as flagged
    whole = F.trim(F.col(raw)).rlike(r"(?s)^\{.*\}$") & is_one_json(F.col(raw))
    verdict = F.when(whole & F.col("__d.__bad").isNull(), F.upper("__d.verdict"))
    ok = F.coalesce(verdict.isin("TRUE_POSITIVE", "FALSE_POSITIVE"), F.lit(False))
    note = F.concat(
        F.lit("unreadable answer: "), F.substring(F.coalesce(F.col(raw), F.lit("")), 1, 100)
    )
    return df.withColumn("__d", doc).withColumns(
        {
            "verdict": F.when(ok, verdict).otherwise("TRUE_POSITIVE"),
            "rationale": F.when(ok, F.coalesce("__d.rationale", F.lit(""))).otherwise(note),
        }
    ).drop("__d")


def text_verdict(scanned: DataFrame, text: str, verdicts: DataFrame | None = None, key: str = "message_name") -> DataFrame:
    """Adds ``text_result``, ``matched_terms`` and ``rationale`` to scanned messages.

    ``verdicts`` (key, verdict, rationale) is the second stage's answer; it counts
    only where a soft term and no hard term was found.
    """
    # Decided before the join, so that the text itself is shuffled only if it is asked for.
    scanned = scanned.withColumn("__blank", is_blank(text))
    if verdicts is None:
        joined = scanned.withColumns({"__v": F.lit(None).cast("string"), "__why": F.lit(None).cast("string")})
    else:
        # of several answers to one message the strictest counts: TRUE_POSITIVE sorts last
        last = F.max(F.struct(F.col("verdict").alias("v"), F.col("rationale").alias("why"))).alias("__a")
        v = verdicts.groupBy(key).agg(last).select(key, F.col("__a.v").alias("__v"), F.col("__a.why").alias("__why"))
        joined = scanned.join(v, key, "left")
    hard, soft = F.size("hard_terms") > 0, F.size("soft_terms") > 0
    blank = F.col("__blank")
    asked = ~blank & ~hard & soft
    result = (
        F.when(blank | (~hard & ~soft), "pass")
        .when(hard, "true_positive")
        .when(F.col("__v") == "TRUE_POSITIVE", "true_positive")
        .when(F.col("__v").isNotNull(), "false_positive")
        .otherwise("flagged_fallback")
    )
    terms = F.when(blank, _strings([])).when(hard, F.col("all_terms")).otherwise(F.col("soft_terms"))
    return joined.withColumns(
        {"text_result": result, "matched_terms": terms, "rationale": F.when(asked, F.col("__why"))}
    ).drop("__v", "__why", "__blank")


# --- images ----------------------------------------------------------------------


def image_format(mime: Column | str) -> Column:
    m = F.lower(mime)
    return F.when(F.contains(m, F.lit("gif")), "gif").when(F.contains(m, F.lit("bmp")), "bmp").otherwise("jpeg")


def image_attachments(msgs: DataFrame, key: str = "message_name") -> DataFrame:
    """One row per scorable attachment: key, image_idx, file name, type, format, resource."""
    fit = F.filter(
        "attachment",
        lambda a: a["contentType"].isin(*K.IMAGE_MIME_TYPES)
        & (F.coalesce(a["attachmentDataRef"]["resourceName"], F.lit("")) != ""),
    )
    return msgs.select(key, F.posexplode(fit).alias("image_idx", "a")).select(
        key,
        "image_idx",
        F.col("a.name").alias("filename"),
        F.col("a.contentType").alias("mime_type"),
        image_format("a.contentType").alias("image_format"),
        F.col("a.attachmentDataRef.resourceName").alias("resource_name"),
    )


def sample_frames(
    frames: DataFrame, fps: float, cap: int, key: str = "attachment_id", order: Sequence[str] = ("frame_idx",)
) -> DataFrame:
    """Every n-th frame by duration, the first ``cap`` per attachment.

    A frame of unknown duration counts as ``FRAME_MS`` long; one of none has no rate and is
    left out, so its attachment falls back as one that could not be scored.
    """
    shown = F.coalesce(F.col("duration_ms"), F.lit(K.FRAME_MS))
    step = F.greatest(F.lit(1), F.floor(F.try_divide(F.lit(1000.0), F.lit(float(fps)) * shown)).cast("int"))
    step = F.when(shown != 0, step)
    w = Window.partitionBy(key).orderBy(*order)
    kept = frames.where(F.pmod(F.col("frame_idx"), step) == 0)
    return kept.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= cap)


def worst_frame(
    frames: DataFrame, key: str = "attachment_id", order: Sequence[str] = ("frame_idx",),
    fallback: str = "review", attachments: DataFrame | None = None,
) -> DataFrame:
    """Verdict per attachment: highest score, first on ties, and the frames counted.

    A null likelihood is a frame that could not be scored.  Attachments listed in
    ``attachments`` but without frames get the fallback with no frames.
    """
    score = F.when(F.col("likelihood").isNotNull(), L.score_likelihood("likelihood"))
    out = frames.withColumn("__s", score).groupBy(key).agg(
        F.min_by(F.struct("__s"), F.struct(-F.coalesce("__s", F.lit(0)), *order)).alias("w"),
        F.count(F.lit(1)).cast("int").alias("frames_scored"),
    )
    out = out.select(key, F.col("w.__s").alias("image_score"), "frames_scored")
    if attachments is not None:
        out = attachments.select(key).join(out, key, "left").withColumn(
            "frames_scored", F.coalesce("frames_scored", F.lit(0))
        )
    return out.withColumn("image_action", F.coalesce(L.score_action("image_score"), F.lit(fallback)))


def worst_image(images: DataFrame, key: str = "message_name", idx: str = "image_idx") -> DataFrame:
    """The image of severest action per message, the first on ties."""
    rest = [c for c in images.columns if c != key]
    rank = L.rank_of("image_action", K.ACTIONS)
    return images.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(-rank, F.col(idx))).alias("w")).select(key, "w.*")


def combine_actions(text_result: Column | str, image_action: Column | str) -> Column:
    """Block beats review beats pass; null stands for no image."""
    t = L.rank_of(L.text_action(text_result), K.ACTIONS)
    i = F.coalesce(L.rank_of(image_action, K.ACTIONS), F.lit(0))
    return L.label_of(F.greatest(t, i), K.ACTIONS)


# --- decisions, cases, evidence ----------------------------------------------------


def decisions(
    texts: DataFrame, images: DataFrame | None = None, engine_version: str = "1.0",
    model: str | None = None, backend: str = "cloud_vision",
) -> DataFrame:
    """One row per message: text verdict, worst image, final action, versions.

    ``images`` has one row per message (see ``worst_image``).
    """
    if images is None:
        joined = texts.withColumns(
            {
                "image_score": F.lit(None).cast("int"),
                "image_action": F.lit(None).cast("string"),
                "image_format": F.lit(None).cast("string"),
                "frames_scored": F.lit(None).cast("int"),
            }
        )
    else:
        cols = ["image_score", "image_action", "image_format", "frames_scored"]
        joined = texts.join(images.select("message_name", *cols), "message_name", "left")
    return joined.withColumns(
        {
            "final_action": combine_actions("text_result", "image_action"),
            "engine_version": F.lit(engine_version),
            "model": F.when(F.col("rationale").isNotNull(), F.lit(model)),
            "backend": F.lit(backend),
        }
    )


def with_case_id(decided: DataFrame) -> DataFrame:
    """Adds ``case_id``, the same at every run, to decisions that open a case."""
    case = uuid_form(sha256(F.concat(F.lit("case:"), F.col("message_name"))))
    return decided.withColumn("case_id", F.when(F.col("final_action") != "pass", case))


def open_cases(decided: DataFrame, opened_at: str) -> DataFrame:
    """A case per review or block decision (which carries ``case_id``)."""
    block = F.col("final_action") == "block"
    score = F.when(block, 80).otherwise(55)
    return decided.where(F.col("final_action") != "pass").select(
        "case_id",
        F.concat(
            F.lit("MOD-"), F.date_format(opened_at, "yyyyMMdd"), F.lit("-"), F.upper(F.substring("case_id", 1, 8))
        ).alias("case_code"),
        F.concat(
            F.lit("Message in "), F.col("space_name"), F.lit(": "), F.col("final_action")
        ).alias("title"),
        F.col("sender_email").alias("subject_ref"),
        F.col(opened_at).alias("opened_at_utc"),
        F.lit("open").alias("disposition"),
        F.when(block, "high").otherwise("medium").alias("severity"),
        score.alias("confidence_score"),
        L.confidence_band(score).alias("confidence_band"),
        F.concat(
            F.lit("message="), F.col("message_name"), F.lit(" action="), F.col("final_action"),
        ).alias("notes"),
        F.nullif(F.col("sender_email"), F.lit("")).alias("sender_email"),
    )


def case_evidence(
    decided: DataFrame, images: DataFrame | None = None, collected_at: Column | None = None, fixed: Mapping[str, object] = K.EVIDENCE,
) -> DataFrame:
    """Evidence rows of every opened case: its text payload, and each image's bytes.

    ``images`` has message_name, image_idx, mime_type and content.  ``collected_at`` is the time of collection, a column of
    ``decided`` (else now).  ``fixed`` gives the values that are the same in all rows.
    """
    decided = decided.withColumn("collected_at_utc", F.current_timestamp() if collected_at is None else collected_at)
    cased = decided.where(F.col("case_id").isNotNull())
    payload = spaced_object(
        {
            "message_name": json_scalar(F.col("message_name")),
            "space_name": json_scalar(F.col("space_name")),
            "sender_email": json_scalar(F.col("sender_email")),
            "text": json_scalar(F.col("text")),
            "text_verdict": json_scalar(F.col("text_result")),
            "matched_terms": json_list(F.col("matched_terms")),
            "llm_rationale": json_scalar(F.col("rationale")),
        }
    )
    texts = cased.where(F.coalesce(F.length("text"), F.lit(0)) > 0).select(
        "case_id",
        "collected_at_utc",
        F.encode(payload, "UTF-8").alias("content"),
        F.lit("application/json").alias("mime_type"),
        F.concat(F.lit(fixed["text_query"]), F.col("message_name")).alias("query"),
    )
    rows = texts
    if images is not None:
        shown = images.join(cased.select("message_name", "case_id", "collected_at_utc"), "message_name").select(
            "case_id",
            "collected_at_utc",
            "content",
            "mime_type",
            F.concat(
                F.lit(fixed["image_query"]), F.col("message_name"), F.lit(":attachment_"),
                F.col("image_idx").cast("string"),
            ).alias("query"),
        )
        rows = texts.unionByName(shown)
    artefact = uuid_form(sha256(F.concat_ws(":", F.col("case_id"), F.col("query"))))
    uri = F.concat(F.lit(fixed["uri"]), F.col("case_id"), F.lit("/"), F.col("artefact_id"))
    same = lambda name: F.lit(fixed[name]).alias(name)
    return rows.withColumn("artefact_id", artefact).select(
        "artefact_id",
        "case_id",
        same("source_system"),
        same("collection_method"),
        "query",
        same("collector_principal"),
        "collected_at_utc",
        same("original_tz"),
        F.octet_length("content").cast("bigint").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        "mime_type",
        uri.alias("s3_uri"),
        F.array(*[F.lit(x) for x in fixed["pii_tags"]]).alias("pii_tags"),
        same("retention_class"),
        F.concat(uri, F.lit(".manifest.json")).alias("manifest_uri"),
        same("signing_key_id"),
        same("manifest_version"),
        "content",
    )


def moderate(
    pushed: DataFrame, kind: str, body: str, terms: DataFrame | Sequence[Term], now: Column,
    directory: DataFrame | None = None, verdicts: DataFrame | None = None, images: DataFrame | None = None,
    full: DataFrame | None = None, model: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """From pushed events to (decisions with case ids, undecodable events), in one plan."""
    msgs, bad = decode_messages(pushed, kind, body, now, full)
    named = msgs.withColumn("sender_email", F.col("sender")) if directory is None else resolve_sender(msgs, directory)
    judged = text_verdict(keyword_scan(named, "text", terms, "message_name"), "text", verdicts)
    return with_case_id(decisions(judged, images, model=model)), bad


# --- dispositions and aftermath ----------------------------------------------------


def disposition_token(case_id: Column | str, disposition: Column | str, key: bytes) -> Column:
    c = F.col(case_id) if isinstance(case_id, str) else case_id
    d = F.col(disposition) if isinstance(disposition, str) else disposition
    return hmac_sha256(key, F.concat(c, F.lit(":"), d))


def check_dispositions(cases: DataFrame, events: DataFrame, key: bytes) -> DataFrame:
    """Adds ``reject_reason`` (null if valid) to (case_id, disposition, token, at, event_id)."""
    known = cases.select("case_id", F.lit(True).alias("__known"))
    allowed = F.coalesce(F.col("disposition").isin(*K.DISPOSITIONS), F.lit(False)) & (
        F.coalesce(F.col("case_id"), F.lit("")) != ""
    )
    signed = F.coalesce(F.col("token") == disposition_token("case_id", "disposition", key), F.lit(False))
    return events.join(known, "case_id", "left").withColumn(
        "reject_reason",
        F.when(~allowed, "invalid_request").when(~signed, "invalid_token").when(F.col("__known").isNull(), "unknown_case"),
    ).drop("__known")


def apply_dispositions(cases: DataFrame, events: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """(cases with their last valid disposition, rejected events)."""
    checked = check_dispositions(cases, events, key)
    last = (
        checked.where(F.col("reject_reason").isNull())
        .groupBy("case_id")
        .agg(F.max_by("disposition", F.struct("at", "event_id")).alias("__d"))
    )
    updated = cases.join(last, "case_id", "left").withColumn("disposition", F.coalesce("__d", "disposition")).drop("__d")
    return updated, checked.where(F.col("reject_reason").isNotNull())


def tombstone(decided: DataFrame, cases: DataFrame, attachments: str | None = None) -> DataFrame:
    """Messages as they read afterwards: blocked ones, and those found true positive, replaced.

    With the name of their array of ``attachments``, these are shown too, and emptied where the text is replaced.
    """
    # most messages have no case: they are spread over the shuffle by a salt that no case carries (a case's is 0,
    # but not a constant, which Spark would put into the condition and join on the case alone)
    later = cases.select(F.col("case_id").alias("__c"), F.col("disposition").alias("__d"), F.pmod(F.xxhash64("case_id"), F.lit(1)).alias("__s"))
    salt = F.when(F.col("case_id").isNull(), 1 + F.pmod(F.xxhash64("message_name"), F.lit(8191))).otherwise(F.lit(0))
    gone = F.coalesce((F.col("final_action") == "block") | (F.col("__d") == "true_positive"), F.lit(False))
    left = []
    if attachments:
        left = [F.when(gone, F.array().cast(decided.schema[attachments].dataType)).otherwise(F.col(attachments)).alias(attachments)]
    met = decided.withColumn("__salt", salt).join(later, (F.col("case_id") == F.col("__c")) & (F.col("__salt") == F.col("__s")), "left")
    return met.select(
        "message_name",
        gone.alias("removed"),
        F.when(gone, K.TOMBSTONE).otherwise(F.col("text")).alias("text"),
        *left,
    )


def reviewer_alerts(decided: DataFrame, time_text: Column, shown_terms: int = 10) -> DataFrame:
    """What a reviewer is told about each review or block decision.

    ``text_flag`` shows the first ``shown_terms`` terms, as the card has room for; ``all_terms`` has them all.
    """
    flagged = F.col("text_result").isin(*K.TEXT_FLAGGED)
    terms = F.array_join(F.slice("matched_terms", 1, shown_terms), ", ")
    text_flag = F.when(flagged, F.concat(F.col("text_result"), F.lit(" — "), terms))
    shown = F.coalesce(F.col("image_action") != "pass", F.lit(False))
    image_flag = F.when(
        shown,
        F.concat(
            F.lit("score="), F.coalesce(F.col("image_score").cast("string"), F.lit("N/A")), F.lit(", action="),
            F.col("image_action"), F.lit(", format="), F.coalesce("image_format", F.lit("unknown")),
        ),
    )
    return decided.where(F.col("final_action") != "pass").select(
        "message_name", "sender_email", "space_name", time_text.alias("time"),
        F.upper("final_action").alias("action"), text_flag.alias("text_flag"),
        F.when(flagged, F.array_join("matched_terms", ", ")).alias("all_terms"),
        F.when(flagged, F.col("rationale")).alias("rationale"), image_flag.alias("image_flag"), "case_id",
    )


def moderation_report(decided: DataFrame, by: str) -> DataFrame:
    """Action and verdict counts per space or sender."""
    counts = [F.count_if(F.col("final_action") == a).alias(a) for a in K.ACTIONS]
    results = ("true_positive", "false_positive", "flagged_fallback")
    return decided.groupBy(by).agg(
        F.count(F.lit(1)).alias("messages"),
        *counts,
        *[F.count_if(F.col("text_result") == r).alias(r) for r in results],
    )


def promotion_gate(
    cases: DataFrame, cls: str, disposition: str, validated: str,
    min_labels: int = 5000, min_accuracy: float = 0.85, max_false: float = 0.10,
) -> DataFrame:
    """Per class: labelled cases, how often review was right, false-positive share, ready or not."""
    labelled = F.col(disposition).isin("true_positive", "false_positive")
    out = cases.groupBy(cls).agg(
        F.count_if(labelled).alias("labelled"),
        F.avg(F.when(labelled & F.col(validated).isNotNull(), (F.col(disposition) == F.col(validated)).cast("int"))).alias("accuracy"),
        F.avg(F.when(labelled, (F.col(disposition) == "false_positive").cast("int"))).alias("false_positive_rate"),
    )
    ready = (
        (F.col("labelled") >= min_labels) & (F.col("accuracy") >= min_accuracy) & (F.col("false_positive_rate") <= max_false)
    )
    return out.withColumn("ready", F.coalesce(ready, F.lit(False)))

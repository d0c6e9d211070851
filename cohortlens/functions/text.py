"""Text features as column expressions (no Python on the executors).

Word boundaries: patterns are matched on *folded* text, where every letter or digit outside ASCII is
replaced by ``_`` one for one.  ``\\b`` then treats accented letters as word characters on every JVM
version, and offsets stay those of the original text.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from cohortlens.functions import lexicons as L

WHITESPACE = " \t\n\r\f\x0b"
FOLD = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]"


def strip(c: Column) -> Column:
    """Both ends without white space (``trim`` alone removes blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def fold(c: Column) -> Column:
    """Letters and digits outside ASCII as ``_``; a text with as many bytes as characters has none."""
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.regexp_replace(c, FOLD, "_"))


def words(c: Column) -> Column:
    """White space separated words."""
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def hits(c: Column, patterns: Iterable[str], ignore_case: bool = True) -> Column:
    """Total number of matches of all patterns."""
    flag = "(?i)" if ignore_case else ""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(c, F.lit(flag + p))
    return total


def merged(patterns: Sequence[str]) -> list[str]:
    """One alternation for the single-word patterns and one for the phrases: two passes instead of many.

    Counts stay sums over the patterns as long as no two patterns can match at overlapping places.
    """
    phrases = [p for p in patterns if " " in p or r"\s" in p]
    single = [p for p in patterns if p not in phrases]
    return ["|".join(g) for g in (single, phrases) if g]


def keyword_hits(lower: Column, keywords: Iterable[str]) -> Column:
    """Number of distinct keywords that occur as substrings of already lower-cased text."""
    total = F.lit(0)
    for k in keywords:
        total = total + lower.contains(k).cast("int")
    return total


# ---- cleaning -------------------------------------------------------------------------------


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, L.URL, "")


def display_text(c: Column) -> Column:
    """URLs as [image] / [link], at most one empty line, stripped."""
    c = F.regexp_replace(c, L.IMAGE_URL, "[image]")
    c = F.regexp_replace(c, L.URL, "[link]")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def truncated(c: Column, length: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit(mark))).otherwise(c)


def collapse_elongation(c: Column) -> Column:
    return F.regexp_replace(c, r"(.)\1{2,}", "$1$1")


def remove_emoji(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, L.EMOJI, ""), r"\s+", " "))


_WORD = r"[\p{L}\p{N}_]"
# "w/x" keeps x as it is when x is a slang word that is only looked at after "w/" was expanded.
_SLANG_TOKEN = (
    rf"[wW]/[oO](?!{_WORD})|[wW]/(?:(?i:bf|gf|ya|u|r|w(?!/{_WORD}))(?!{_WORD}))|[wW]/(?={_WORD})|{_WORD}+|(?:(?!{_WORD})[\s\S])+"
)


def expand_slang(c: Column, slang: dict[str, str] | None = None) -> Column:
    """One pass over word tokens; a capital first letter is kept."""
    slang = L.SLANG if slang is None else slang
    table = F.create_map(*[F.lit(x) for kv in slang.items() for x in kv])
    keys = list(slang)

    def cased(token: Column, form: Column) -> Column:
        head = F.substring(token, 1, 1)
        upper = (head == F.upper(head)) & (head != F.lower(head))
        return F.when(upper, F.concat(F.upper(F.substring(form, 1, 1)), F.substr(form, F.lit(2)))).otherwise(form)

    def one(token: Column) -> Column:
        low = F.lower(token)
        form = F.when(low.isin(keys), cased(token, table[low]))
        if "w/" in slang:
            glued = low.startswith("w/") & ~low.isin("w/o")
            form = F.when(
                glued, F.concat(cased(F.substring(token, 1, 2), F.lit(slang["w/"])), F.substr(token, F.lit(3)))
            ).otherwise(form)
        return F.coalesce(form, token)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_SLANG_TOKEN), F.lit(0)), one), "")


def normalise(c: Column) -> Column:
    """Elongation, then slang, then emoji."""
    return remove_emoji(expand_slang(collapse_elongation(c)))


# ---- companion entities ---------------------------------------------------------------------


def _quoted(term: str) -> str:
    return "".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in term)


def _clashes(later: str, earlier: str) -> bool:
    """Would a match of ``later`` starting first hide an overlapping match of ``earlier``?"""
    for i in range(1, len(later)):
        boundary = later[i - 1].isalnum() != later[i].isalnum()
        if boundary and len(later) - i < len(earlier) and earlier.startswith(later[i:]):
            return True
    return False


def entity_tiers(variants: Sequence[str] | None = None) -> list[list[str]]:
    """Variants, longest first, in as few groups as keep "longest first" exact across overlaps."""
    tiers: list[list[str]] = []
    for v in sorted(L.ENTITY_VARIANTS if variants is None else variants, key=len, reverse=True):
        if not tiers or any(_clashes(v, u) for u in tiers[-1]):
            tiers.append([])
        tiers[-1].append(v)
    return tiers


def entity_pattern(variants: Sequence[str]) -> str:
    return r"(?:" + "|".join(_quoted(v) for v in variants) + r")"


def _java_bounded(pattern: str) -> str:
    return rf"(?i)(?<!{_WORD}){pattern}(?!{_WORD})"


def has_entity(c: Column, variants: Sequence[str] | None = None) -> Column:
    ordered = [v for tier in entity_tiers(variants) for v in tier]
    return c.rlike(_java_bounded(entity_pattern(ordered)))


def replace_entities(c: Column, token: str = L.ENTITY_TOKEN, variants: Sequence[str] | None = None) -> Column:
    """Every variant becomes the token; texts without any variant skip the replacement passes."""
    out = c
    for tier in entity_tiers(variants):
        out = F.regexp_replace(out, _java_bounded(entity_pattern(tier)), token.replace("$", r"\$"))
    return F.when(has_entity(c, variants), out).otherwise(c)


def with_entity_positions(df, text: str = "body", out: str = "positions", variants: Sequence[str] | None = None):
    """Adds an array of (start, end, variant) over all variants, overlapping ones included.

    Only variants found by a plain substring test are searched for with their pattern.  The folded text
    is a column of its own: inside the lambdas it would be computed again for every variant.
    """
    return (
        df.withColumn("_low", fold(F.lower(F.col(text)))).withColumn(out, _occurrences(F.col("_low"), variants)).drop("_low")
    )


def exploded(df, array: str, out: str, *keep: str):
    """One row per element.

    ``explode`` makes the planner derive a non-empty test that computes the array a second time; the outer
    form followed by a null test does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(out)).where(F.col(out).isNotNull())


def _occurrences(low: Column, variants: Sequence[str] | None) -> Column:
    names = L.ENTITY_VARIANTS if variants is None else variants
    known = F.array(
        *[F.struct(F.lit(v).alias("v"), F.lit(rf"(?<!\w){_quoted(v)}(?!\w)").alias("p")) for v in names]
    )
    zero = F.struct(
        F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,variant:string>>").alias("spans")
    )

    def spans(x: Column) -> Column:
        """Every match has the variant's length, so the pieces between matches give the offsets."""
        pieces = F.split(low, x["p"], -1)
        size = F.length(x["v"])

        def step(acc: Column, piece: Column) -> Column:
            start = acc["pos"] + F.length(piece)
            span = F.struct(start.alias("start"), (start + size).alias("end"), x["v"].alias("variant"))
            return F.struct((start + size).alias("pos"), F.array_append(acc["spans"], span).alias("spans"))

        found = F.aggregate(pieces, zero, step)["spans"]
        return F.slice(found, F.lit(1), F.size(found) - 1)

    present = F.filter(known, lambda x: F.contains(low, x["v"]))
    return F.array_sort(F.flatten(F.transform(present, spans)))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.length(strip(s)) > 0)


def masked_sentences(c: Column, mask: str = L.MASK_TOKEN, variants: Sequence[str] | None = None) -> Column:
    """Sentences that mention an entity, with the mention masked."""
    return F.transform(
        F.filter(sentences(c), lambda s: has_entity(s, variants)),
        lambda s: replace_entities(s, mask, variants),
    )


# ---- n-grams --------------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(L.TOKEN), F.lit(0))


def _joined(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(toks: Column) -> Column:
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return _joined(F.slice(toks, F.lit(1), n), F.slice(toks, F.lit(2), n))


def trigrams(toks: Column, pairs: Column | None = None) -> Column:
    """``pairs`` are the bigrams, where a column already holds them."""
    n = F.greatest(F.size(toks) - 2, F.lit(0))
    return _joined(F.slice(bigrams(toks) if pairs is None else pairs, F.lit(1), n), F.slice(toks, F.lit(3), n))


def _branches(terms: Iterable[str]) -> str:
    """Pattern of the terms that shares their common starts, so that a place costs one try per first letter, not per term."""
    heads: dict[str, set[str]] = {}
    for t in terms:
        heads.setdefault(t[:1], set()).add(t[1:])
    ends = "" in heads
    parts = [_quoted(h) + _branches(rest) for h, rest in sorted(heads.items()) if h]
    body = "|".join(parts)
    return f"(?:{body})?" if ends and parts else f"(?:{body})" if len(parts) > 1 else body


def _known(joined: Column, side: int) -> Column:
    """The few n-grams that are in any category, later counts run over these only.

    ``joined`` has one blank on either side of each token.  The pattern is empty but for its group, so n-grams that
    overlap are all found; at most one of a length starts at a token.
    """
    union = sorted({t for group in (L.HUMANISING_NGRAMS, L.TOOL_NGRAMS) for pair in group.values() for t in pair[side]})
    return F.regexp_extract_all(joined, F.lit(f"(?<= )(?=({_branches(union)}) )"), F.lit(1))


def with_ngram_features(df, text: str = "body"):
    """Adds the twelve ``ngram_*`` columns; null and empty text give zeros."""
    toks = tokens(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_tok", toks).withColumn("_joined", F.concat(F.lit(" "), F.array_join("_tok", " "), F.lit(" ")))
    df = df.withColumns({"_bi": _known(F.col("_joined"), 0), "_tri": _known(F.col("_joined"), 1)})

    def count(pair) -> Column:
        bi, tri = pair
        n = F.size(F.filter("_bi", lambda g: g.isin(bi))) if bi else F.lit(0)
        return n + (F.size(F.filter("_tri", lambda g: g.isin(tri))) if tri else F.lit(0))

    human = {k: count(v) for k, v in L.HUMANISING_NGRAMS.items()}
    tool = {k: count(v) for k, v in L.TOOL_NGRAMS.items()}
    df = df.select("*", *[c.cast("double").alias(f"ngram_{k}") for k, c in {**human, **tool}.items()])
    a = sum((F.col(f"ngram_{k}") for k in human), F.lit(0.0))
    d = sum((F.col(f"ngram_{k}") for k in tool), F.lit(0.0))
    n = F.size("_tok")
    total = (F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))).cast("double")
    return (
        df.withColumns({"ngram_anthro_total": a, "ngram_deanthro_total": d})
        .withColumns(
            {
                "ngram_anthro_density": F.coalesce(F.try_divide("ngram_anthro_total", total), F.lit(0.0)),
                "ngram_deanthro_density": F.coalesce(F.try_divide("ngram_deanthro_total", total), F.lit(0.0)),
                "ngram_net_signal": F.coalesce(
                    F.try_divide(
                        F.col("ngram_anthro_total") - F.col("ngram_deanthro_total"),
                        F.col("ngram_anthro_total") + F.col("ngram_deanthro_total"),
                    ),
                    F.lit(0.0),
                ),
            }
        )
        .drop("_tok", "_joined", "_bi", "_tri")
    )


# ---- attribution of emotions ----------------------------------------------------------------


def with_attribution(df, text: str = "body"):
    """Who is said to feel: counts of hits, type, score and all matches."""
    body = strip(fold(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("_b", body)
    # texts without a companion's name before white space skip the patterns that begin with one
    start = rf"\b{L.COMPANION}\s+"
    named = F.col("_b").rlike("(?i)" + start)
    all_of = lambda p: F.regexp_extract_all("_b", F.lit("(?i)" + p), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn("_named", named)
    found = F.concat(*[F.when(F.col("_named"), all_of(p)).otherwise(none) if p.startswith(start) else all_of(p) for p in L.BOT_EMOTION_PATTERNS])
    df = df.withColumns({"_found": found, "n_self": hits(F.col("_b"), L.SELF_EMOTION_PATTERNS)})
    df = df.withColumn("n_bot", F.size("_found"))
    bot, own = F.col("n_bot") > 0, F.col("n_self") > 0
    return df.select(
        "*",
        bot.alias("bot_attributed"),
        own.alias("self_expressed"),
        F.when(bot & own, "mixed").when(bot, "bot").when(own, "self").otherwise("none").alias("attribution_type"),
        F.when(bot & own, F.col("n_bot") / (F.col("n_bot") + F.col("n_self")))
        .when(bot, F.least(F.lit(1.0), F.col("n_bot") * F.lit(0.4)))
        .otherwise(F.lit(0.0))
        .alias("bot_attribution_score"),
        F.col("_found").alias("matched_patterns"),
    ).drop("_b", "_found", "_named")


def weighted_emotions(prefix: str = "emotion_", out: str = "bot_emotion_", weight: str = "bot_attribution_score") -> dict:
    return {f"{out}{e}": F.col(f"{prefix}{e}") * F.col(weight) for e in L.EMOTIONS}


def dominant(prefix: str = "emotion_", empty: str | None = None) -> Column:
    """Label of the largest column, ties to the first label; ``empty`` when all are zero."""
    cols = [F.col(f"{prefix}{e}") for e in L.EMOTIONS]
    top = F.greatest(*cols)
    label = None
    for e, c in zip(L.EMOTIONS, cols):
        label = F.when(c == top, e) if label is None else label.when(c == top, e)
    if empty is not None:
        total = sum(cols[1:], cols[0])
        label = F.when(total > 0, label).otherwise(empty)
    return label


def dominant_score(prefix: str = "emotion_") -> Column:
    return F.greatest(*[F.col(f"{prefix}{e}") for e in L.EMOTIONS])


# ---- language and content -------------------------------------------------------------------


def linguistic_features(text: str = "body") -> dict[str, Column]:
    c = F.col(text)
    f = fold(c)
    n = word_count(c)
    low = F.lower(f)
    letters = F.length(F.regexp_replace(c, r"\s+", ""))
    parts = F.size(F.filter(F.split(c, r"[.!?]+"), lambda s: F.length(strip(s)) > 0))
    n_sent = F.greatest(F.lit(1), parts)
    per = F.greatest(F.lit(1), n)
    out = {
        "word_count": n,
        "sentence_count": n_sent,
        "words_per_sentence": n / n_sent,
        "avg_word_length": F.coalesce(F.try_divide(letters, n), F.lit(0.0)),
    }
    for name, p in L.PRONOUNS.items():
        out[f"{name}_pct"] = F.regexp_count(low, F.lit(p)) / per * 100
    out |= {
        "questions": F.length(c) - F.length(F.translate(c, "?", "")),
        "exclamations": F.length(c) - F.length(F.translate(c, "!", "")),
        "emoticons": F.regexp_count(c, F.lit(L.EMOTICON)),
        "all_caps": F.regexp_count(f, F.lit(L.ALL_CAPS)),
    }
    return out


def keyword_features(text: str, lists: dict[str, list[str]], prefix: str, total: str | None = None) -> dict[str, Column]:
    """One count per list; ``total`` names an optional sum over all lists."""
    low = F.lower(F.col(text))
    out = {f"{prefix}{k}": keyword_hits(low, v) for k, v in lists.items()}
    if total:
        out[total] = sum(out.values(), F.lit(0))
    return out


def content_flags(text: str = "body") -> dict[str, Column]:
    f = fold(F.coalesce(F.col(text), F.lit("")))
    return {f"has_{k}": f.rlike("(?i)" + p).cast("int") for k, p in L.CONTENT_PATTERNS.items()}


def marker_counts(text: str = "body") -> dict[str, Column]:
    """Per comment counts that the per user rates sum up."""
    low = fold(F.lower(F.col(text)))
    c = F.lower(F.col(text))
    return {
        "female_count": hits(low, merged(L.FEMALE_MARKERS), ignore_case=False),
        "male_count": hits(low, merged(L.MALE_MARKERS), ignore_case=False),
        "words": word_count(c),
        "letters": F.length(F.regexp_replace(c, r"\s+", "")),
        "exclaims": F.regexp_count(c, F.lit("!")),
        "asks": F.regexp_count(c, F.lit(r"\?")),
        "emoticons": F.regexp_count(c, F.lit(L.MARKER_EMOTICON)),
    }


def vocabulary_signals(text: str = "body") -> dict[str, Column]:
    f = fold(F.coalesce(F.col(text), F.lit("")))
    return {"word_count": F.regexp_count(f, F.lit(r"\b\w+\b")), "char_count": F.length(f)}


# ---- prefilter ------------------------------------------------------------------------------


def with_prefilter(df, text: str = "body", out: str = "prefilter"):
    """Adds struct(skip, score, reason): cheap decisions before any scorer is called.

    Stripped text and reason are columns of their own, so that each is computed once per row.
    """
    c = F.col("_c")
    lower = F.lower(c)
    technical = (keyword_hits(lower, L.TECHNICAL_TERMS) >= 2) & ~F.lower(fold(c)).rlike(L.AI_REFERENCE)
    reason = (
        F.when(F.col("_empty"), "empty")
        .when(F.length(c) < L.PREFILTER_MIN_CHARS, "too_short")
        .when(word_count(c) < L.PREFILTER_MIN_WORDS, "too_few_words")
        .when(technical, "technical_only")
        .otherwise("needs_scoring")
    )
    empty = F.col(text).isNull() | (F.length(text) == 0)
    df = df.withColumns({"_c": strip(F.coalesce(F.col(text), F.lit(""))), "_empty": empty}).withColumn("_reason", reason)
    skip = F.col("_reason") != "needs_scoring"
    return df.withColumn(
        out,
        F.struct(skip.alias("skip"), F.when(skip, 1).otherwise(0).alias("score"), F.col("_reason").alias("reason")),
    ).drop("_c", "_empty", "_reason")


def annotation_eligible(text: str = "body", min_length: int = 30, max_brackets: int = 3) -> Column:
    shown = strip(F.regexp_replace(display_text(F.col(text)), r"\[(image|link)\]", ""))
    return (F.length(shown) >= min_length) & (F.regexp_count(shown, F.lit(r"\[")) <= max_brackets)


# ---- stored model replies -------------------------------------------------------------------


def parse_reply(reply: Column) -> Column:
    """struct(score, reasoning) from a JSON reply: 1–5, numbers clamped, anything else 0."""
    raw = F.get_json_object(reply, "$.score")
    number = raw.try_cast("double")
    quoted = reply.rlike(r'"score"\s*:\s*"')
    score = F.when(number.isNotNull() & ~quoted, F.floor(F.greatest(F.lit(1.0), F.least(F.lit(5.0), number)))).otherwise(0)
    return F.struct(
        score.cast("int").alias("score"),
        F.coalesce(F.get_json_object(reply, "$.r"), F.get_json_object(reply, "$.reasoning"), F.lit("")).alias("reasoning"),
    )

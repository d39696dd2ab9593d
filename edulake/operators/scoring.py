"""Rule-based row scores. Every score is a Column expression over one row: no shuffle, no Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from edulake.functions import text as tx
from edulake.functions.lexicon import DEFAULT_LEXICON, RULE_WEIGHTS, STEP_WORDS, Lexicon
from edulake.functions.numeric import clamp, weighted_sum

#: Inverse document frequency of a token that occurs in both of two documents; in one document it is 1.
IDF_SHARED = 1.0 + math.log(2.0 / 3.0)


# -- flags -------------------------------------------------------------------------------------------------


def answer_contained(response: Column, answer: Column) -> Column:
    return response.contains(answer)


def answer_in_prefix(response: Column, answer: Column, chars: int = 50) -> Column:
    return F.substring(response, 1, chars).contains(answer)


def token_overlap(response: Column, answer: Column, answer_tokens: int = 10, response_tokens: int = 20) -> Column:
    """The first words of the answer and of the response share a word."""
    return F.arrays_overlap(
        F.slice(tx.words(answer), 1, answer_tokens), F.slice(tx.words(response), 1, response_tokens)
    )


def step_flag(response: Column, step_words: tuple[str, ...] = STEP_WORDS, at_least: int = 1) -> Column:
    """At least so many of the step words occur."""
    if at_least == 1:
        return tx.contains_any(response, step_words)
    found = F.lit(0)
    for word in step_words:
        found = found + response.contains(word).cast("int")
    return found >= at_least


def final_answer(text: Column) -> Column:
    """The choice letter or number after the last-answer phrase, or null."""
    return F.nullif(F.regexp_extract(text, f"答案[是为：:]+{tx.SPACE}*([A-D]|{tx.NUMBER})", 1), F.lit(""))


def final_answer_match(response: Column, answer: Column) -> Column:
    return F.coalesce(final_answer(response) == final_answer(answer), F.lit(False))


def numeric_match(response: Column, answer: Column, tolerance: float = 1e-3) -> Column:
    """The last numbers of both texts differ by no more than the tolerance."""
    last = [
        F.try_element_at(F.regexp_extract_all(side, F.lit(r"-?" + tx.NUMBER), F.lit(0)), F.lit(-1)).try_cast("double")
        for side in (response, answer)
    ]
    return F.coalesce(F.abs(last[0] - last[1]) <= tolerance, F.lit(False))


# -- similarity --------------------------------------------------------------------------------------------


def _fold(tokens: Column, names: tuple[str, ...], start: tuple, step, finish) -> Column:
    """Fold a list with a state of named whole numbers beside the current token."""

    def state(*values) -> Column:
        columns = [v if isinstance(v, Column) else F.lit(v).cast("bigint") for v in values]
        return F.struct(*[c.alias(n) for n, c in zip(("token", *names), columns)])

    return F.aggregate(tokens, state(F.lit(""), *start), lambda run, item: step(state, run, item), finish)


def _token_sums(left: Column, right: Column) -> Column:
    """Over the counts l and r of every token: sums of l*l and r*r as ``all_l`` and ``all_r``, and of l*r, l*l and r*r
    over the tokens of both lists as ``dot``, ``ll`` and ``rr``.

    The lists are sorted together by token and side, so the left occurrences of a token come first and its first
    right occurrence makes it a shared one. A square grows by 2n + 1 when its count grows from n to n + 1.
    """

    def tagged(tokens: Column, side: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(side).alias("side")))

    def step(state, run: Column, item: Column) -> Column:
        shared = (run.dot, run.ll, run.rr)
        more_left = state(run.token, run.l + 1, run.r, run.all_l + run.l + run.l + 1, run.all_r, *shared)
        more_right = state(
            run.token,
            run.l,
            run.r + 1,
            run.all_l,
            run.all_r + run.r + run.r + 1,
            run.dot + run.l,
            F.when(run.r == 0, run.ll + run.l * run.l).otherwise(run.ll),
            F.when(run.l > 0, run.rr + run.r + run.r + 1).otherwise(run.rr),
        )
        first_left = state(item.token, 1, 0, run.all_l + 1, run.all_r, *shared)
        first_right = state(item.token, 0, 1, run.all_l, run.all_r + 1, *shared)
        more = F.when(item.side == 0, more_left).otherwise(more_right)
        return F.when(run.token == item.token, more).when(item.side == 0, first_left).otherwise(first_right)

    merged = F.sort_array(F.concat(tagged(left, 0), tagged(right, 1)))
    names = ("l", "r", "all_l", "all_r", "dot", "ll", "rr")
    return _fold(merged, names, (0,) * len(names), step, lambda run: run)


def tfidf_cosine(left: Column, right: Column) -> Column:
    """Cosine of the TF-IDF vectors of two token lists of one row.

    Every token weighs 1 but those of both lists, so the squared lengths come from the counts of each list alone,
    and only shared tokens add to the product. The cost is that of sorting the row's own tokens once, and nothing leaves
    the row. Both lists are bound once, however dear the expressions that make them.
    """

    def cosine(t: Column) -> Column:
        weight = IDF_SHARED * IDF_SHARED
        ll = t["all_l"] - (1 - weight) * t["ll"]
        rr = t["all_r"] - (1 - weight) * t["rr"]
        return F.when((ll > 0) & (rr > 0), weight * t["dot"] / (F.sqrt(ll) * F.sqrt(rr))).otherwise(F.lit(0.0))

    return tx.let(tx.let(F.struct(left.alias("left"), right.alias("right")), lambda s: _token_sums(s["left"], s["right"])), cosine)


def keyword_recall(response: Column, answer: Column) -> Column:
    """Share of the answer's keywords that the response holds; 0.5 when the answer has none."""
    sides = F.struct(tx.keywords(response).alias("found"), tx.keywords(answer).alias("wanted"))
    return tx.let(sides, lambda s: _recall(s["found"], s["wanted"]))


def _recall(found: Column, wanted: Column) -> Column:
    shared = F.size(F.array_intersect(wanted, found))
    return F.when(F.size(wanted) == 0, F.lit(0.5)).otherwise(shared / F.greatest(F.size(wanted), F.lit(1)))


def number_match(response: Column, answer: Column, tolerance: float = 0.05) -> Column:
    """Agreement of the number sets of response and answer."""
    sides = F.struct(tx.numbers(response).alias("found"), tx.numbers(answer).alias("wanted"))
    return tx.let(sides, lambda s: _number_match_sets(s["found"], s["wanted"], tolerance))


def _number_match_sets(found: Column, wanted: Column, tolerance: float) -> Column:
    """Both sides must be bound values: the inner pair test reads ``found`` once per wanted number."""
    shared = F.array_intersect(found, wanted)
    merged = F.size(F.array_union(found, wanted))
    # A shared number other than zero is its own close pair; only when all shared numbers are zero must the
    # remaining pairs be looked at.
    shared_non_zero = F.exists(shared, lambda n: n.try_cast("double") != 0)
    close = F.exists(
        wanted,
        lambda g: F.exists(
            found,
            lambda r: (g.try_cast("double") != 0)
            & (F.abs(r.try_cast("double") - g.try_cast("double")) < tolerance * g.try_cast("double")),
        ),
    )
    return (
        F.when(F.size(wanted) == 0, F.lit(0.5))
        .when((F.size(shared) == F.size(wanted)) & (F.size(found) == F.size(wanted)), F.lit(1.0))
        .when((F.size(shared) > 0) & F.coalesce(shared_non_zero, F.lit(False)), F.lit(0.7))
        .when((F.size(shared) > 0) & F.coalesce(close, F.lit(False)), F.lit(0.7))
        .otherwise(F.size(shared) / merged)
    )


# -- the five dimensions -----------------------------------------------------------------------------------


def accuracy_score(response: Column, answer: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Keyword recall, similarity of the normalised texts and number agreement in one score."""

    def parts(text: Column) -> Column:
        return tx.let(
            tx.latin_runs(text),
            lambda latin: F.struct(
                tx.keywords(text, latin).alias("keywords"),
                tx.normal_tokens(text, lexicon.numbers, latin).alias("tokens"),
                tx.numbers(text).alias("numbers"),
            ),
        )

    def total(sides: Column) -> Column:
        found, wanted = sides["response"], sides["answer"]
        score = (
            0.4 * _recall(found["keywords"], wanted["keywords"])
            + 0.4 * tfidf_cosine(wanted["tokens"], found["tokens"])
            + 0.2 * _number_match_sets(found["numbers"], wanted["numbers"], 0.05)
        )
        return F.least(score, F.lit(1.0))

    both = F.struct(parts(response).alias("response"), parts(answer).alias("answer"))
    return F.when(F.coalesce(answer, F.lit("")) == "", F.lit(0.0)).otherwise(tx.let(both, total))


def completeness_score(response: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    found = tx.count_matching(response, lexicon.steps)
    return F.when(found >= 4, 1.0).when(found >= 2, 0.7).when(found >= 1, 0.4).otherwise(0.1)


def fluency_score(response: Column) -> Column:
    """Share of distinct character pairs. A pair is the number made of its two code points."""
    codes = F.transform(F.split(response, ""), lambda c: F.ascii(c).cast("bigint"))
    pairs = tx.let(
        codes,
        lambda c: F.zip_with(
            F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))),
            F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))),
            lambda a, b: F.shiftleft(a, 21) + b,
        ),
    )
    distinct = F.size(F.array_distinct(pairs))
    return F.when(F.length(response) < 2, F.lit(0.0)).otherwise(distinct / (F.length(response) - 1))


def scaffolding_score(response: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    hits = tx.count_occurrences(response, lexicon.scaffolding)
    density = hits / (F.greatest(F.length(response), F.lit(1)) / F.lit(50.0))
    guidance = F.when(density > 3, 0.5).when(density > 1.5, 0.35).when(density > 0.5, 0.2).otherwise(0.05)
    direct = F.when(tx.matches_any(tx.strip(response), lexicon.direct_answers), -0.3).otherwise(0.0)
    return clamp(direct + guidance + 0.3, 0.0, 1.0)


def format_score(response: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    length = F.length(response)
    short = F.when(length < 20, 0.4).otherwise(0.0)
    noisy = F.when(
        (length > 0) & (tx.count_chars(response, lexicon.symbols) / F.greatest(length, F.lit(1)) > 0.05), 0.3
    ).otherwise(0.0)
    stripped = tx.strip(response)
    open_end = F.when(
        (stripped != "") & ~F.lit(lexicon.ends).contains(F.right(stripped, F.lit(1))), 0.1
    ).otherwise(0.0)
    return F.greatest(F.lit(1.0) - short - noisy - open_end, F.lit(0.0))


def rule_dimensions(response: Column, answer: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> dict[str, Column]:
    """The five rule scores by name."""
    return {
        "accuracy": accuracy_score(response, answer, lexicon),
        "completeness": completeness_score(response, lexicon),
        "fluency": fluency_score(response),
        "scaffolding": scaffolding_score(response, lexicon),
        "format": format_score(response, lexicon),
    }


def rule_reward(
    response: Column,
    answer: Column,
    lexicon: Lexicon = DEFAULT_LEXICON,
    weights: dict[str, float] = RULE_WEIGHTS,
) -> Column:
    return weighted_sum(rule_dimensions(response, answer, lexicon), weights)

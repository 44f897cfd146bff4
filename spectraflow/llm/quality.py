"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote +1 (good), -1 (bad) or abstain. Texts with the same votes are one
row of a table of at most 3 ** rules rows, on which expectation-maximisation
estimates how often each rule votes each way for good and for bad texts. The
posterior probability of a good text then decides, instead of every rule
having to pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraflow.llm.common import WORD_SPACES, materialise

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = ("long_enough", "word_length", "few_symbols", "plain_words", "fresh_lines", "fresh_words", "lower_case", "rich_words", "sentences")
#: Rounds of expectation-maximisation and smoothing of its rates; at first a text is good by 1 + 0.1 per good vote - 3 per bad vote, in log-odds.
ROUNDS, SMOOTH, START, FOR, AGAINST = 12, 0.5, 1.0, 0.1, 3.0


def base_features(documents: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and what the rules need besides."""
    spaces = F.lit(WORD_SPACES)
    text = F.coalesce(F.col("text"), F.lit(""))
    one = documents.withColumn("__text", text)
    one = one.withColumn("__words", F.array_remove(F.split(F.translate(F.col("__text"), WORD_SPACES, " " * len(WORD_SPACES)), " "), ""))
    one = one.withColumn("__lines", F.filter(F.split(F.col("__text"), "\n"), lambda x: F.length(F.btrim(x, spaces)) > 0))
    one = one.withColumn("n_words", F.size("__words").cast("long"))
    windows = F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(1), (F.col("n_words") - 4).cast("int")), lambda i: F.xxhash64(F.slice(F.col("__words"), i, 5))))
    one = one.withColumn("__windows", windows)
    # only texts with an equal pair of windows need to find where: sort (hash, place), keep those next to their equal
    pairs = F.sort_array(F.arrays_zip(F.col("__windows").alias("h"), F.sequence(F.lit(1), F.size("__windows")).alias("p")))
    one = one.withColumn("__pairs", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), pairs))
    same = F.filter(
        F.col("__pairs"),
        lambda x, i: ((i > 0) & (F.get(F.col("__pairs"), i - 1)["h"] == x["h"])) | F.coalesce(F.get(F.col("__pairs"), i + 1)["h"] == x["h"], F.lit(False)),
    )
    places = F.sort_array(F.transform(same, lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-5).alias("last"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["covered"] + F.least(F.lit(5), p - a["last"])).alias("covered"), p.alias("last")))["covered"]
    length = F.char_length("__text")
    return one.select(
        *documents.columns,
        "n_words",
        F.char_length(F.translate(F.col("__text"), WORD_SPACES, "")).cast("long").alias("word_chars"),
        (length - F.char_length(F.translate(F.col("__text"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(F.col("__words"), lambda w: F.translate(w, SYMBOLS, "") != w)).cast("long").alias("__n_marked"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (length - F.char_length(F.translate(F.col("__text"), CAPITALS, ""))).cast("long").alias("__n_capitals"),
        F.size(F.array_distinct("__words")).cast("long").alias("__n_distinct"),
        (length - F.char_length(F.translate(F.col("__text"), ".!?:", ""))).cast("long").alias("__n_stops"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> list[Column]:
    """A column per rule: 1 good, -1 bad, 0 abstains. Shares and powers are of whole numbers, so no rounding decides."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return [
        vote(n >= 40, n < 10),
        vote((chars >= 3 * n) & (chars <= 12 * n), (chars < 2 * n) | (chars > 25 * n)),
        vote(50 * F.col("n_symbols") <= n, 5 * F.col("n_symbols") > n),
        vote(50 * F.col("__n_marked") <= n, 5 * F.col("__n_marked") > n),
        vote(10 * F.col("n_dup_lines") <= F.col("__n_lines"), 3 * F.col("n_dup_lines") > F.col("__n_lines")),
        vote(20 * F.col("n_repeat_words") <= n, 5 * F.col("n_repeat_words") > n),
        vote((n >= 20) & (8 * F.col("__n_capitals") <= chars), (n >= 20) & (3 * F.col("__n_capitals") > chars)),
        vote(3 * F.col("__n_distinct") >= n, 16 * F.pow(F.col("__n_distinct"), F.lit(4)) < F.pow(n, F.lit(3))),  # new words become rarer as a text goes on
        vote((n >= 20) & (30 * F.col("__n_stops") >= n) & (2 * F.col("__n_stops") <= n), (n >= 20) & ((100 * F.col("__n_stops") < n) | (4 * F.col("__n_stops") > 3 * n))),
    ]


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(60.0)), F.lit(-60.0))))


def _log_odds(vote_list: Column, model: Column) -> Column:
    """Prior log-odds, and each vote's by how much likelier good texts than bad ones get it from a rule that votes."""
    return F.aggregate(
        F.zip_with(vote_list, model["rules"], lambda v, r: F.when(v == 1, r["good"]).when(v == -1, r["bad"]).otherwise(F.lit(0.0))),
        model["prior"],
        lambda acc, x: acc + x,
    )


def learn(voted: DataFrame) -> DataFrame:
    """One row, ``model``: prior log-odds and each rule's log-odds. ``voted`` has ``votes`` array<int>.

    Texts are counted by vote pattern first; all rounds run over those counts.
    Without rows the model has no say: prior and rules 0.
    """
    counts = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = counts.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))  # 3 ** rules structs at most
    tally = lambda p, x: F.size(F.filter(p["votes"], lambda v: v == x))
    one = one.withColumn("first", F.transform("patterns", lambda p: _sigmoid(START + FOR * tally(p, 1) - AGAINST * tally(p, -1))))
    nothing = F.struct(F.lit(0.0).alias("prior"), F.transform(F.array_repeat(F.lit(0), len(RULES)), lambda _: F.struct(F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))).alias("rules"))

    def step(state: Column, _: Column) -> Column:
        cells = F.zip_with(F.col("patterns"), state["q"], lambda p, q: F.struct(p["votes"].alias("votes"), (p["n"] * q).alias("g"), (p["n"] * (1 - q)).alias("b")))

        def total(side: str, keep) -> Column:
            return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + F.when(keep(c), c[side]).otherwise(F.lit(0.0)))

        def rule(k: Column) -> Column:
            at = lambda c: F.get(c["votes"], k)
            up, down = (lambda c: at(c) == 1), (lambda c: at(c) == -1)
            gp, gm, bp, bm = total("g", up), total("g", down), total("b", up), total("b", down)
            good_all, bad_all = gp + gm + 2 * SMOOTH, bp + bm + 2 * SMOOTH
            return F.struct(
                F.log(((gp + SMOOTH) / good_all) / ((bp + SMOOTH) / bad_all)).alias("good"),
                F.log(((gm + SMOOTH) / good_all) / ((bm + SMOOTH) / bad_all)).alias("bad"),
            )

        always = lambda c: F.lit(True)
        prior = F.log((total("g", always) + SMOOTH) / (total("b", always) + SMOOTH))
        model = F.struct(prior.alias("prior"), F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), rule).alias("rules"))
        return F.transform(F.array(model), lambda m: F.struct(F.transform(F.col("patterns"), lambda p: _sigmoid(_log_odds(p["votes"], m))).alias("q"), m.alias("model")))[0]

    state = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.col("first").alias("q"), nothing.alias("model")), step)
    return one.select(F.when(F.size("patterns") > 0, state["model"]).otherwise(nothing).alias("model"))


def judge(documents: DataFrame, narrow: list[str] | None = None) -> DataFrame:
    """Add the base features, ``base_failed``, ``quality`` (posterior, double) and ``kept`` to every row.

    ``narrow`` names the input columns to return (all by default). They and the
    features are written once and read for both uses; in one plan the features'
    expressions would be copied into every filter. Null and empty texts have no words and fail the base rules. Equal
    texts get equal values; an empty table gives an empty one; input columns of
    the added names are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes", "base_failed", "quality", "kept"]
    rows = documents.drop(*added)
    voted = base_features(rows)
    voted = voted.withColumn("votes", F.array(*votes())).withColumn("base_failed", base_failed())
    names = rows.columns if narrow is None else narrow
    voted = materialise(voted.select(*names, *added[:7]), "quality")
    model = learn(voted.select("votes")).withColumnRenamed("model", "__model")  # one row
    scored = voted.crossJoin(F.broadcast(model)).withColumn("quality", _sigmoid(_log_odds(F.col("votes"), F.col("__model"))))
    scored = scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    return scored.select(*names, *added)


def good(documents: DataFrame) -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns, whatever their names."""
    rows = documents.select(F.struct(*documents.columns).alias("__row"), "text")
    return judge(rows, ["__row"]).where("kept").select("__row.*")

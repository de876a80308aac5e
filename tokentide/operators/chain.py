"""Pool logs as prices, liquidity and trades: 256-bit words read from hex, rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.functions.wide import compared, difference
from tokentide.operators.asof import as_of

#: The outermost tick, how near to it a pool is empty, and the largest believable rise over the entry price.
MAX_TICK, TICK_SLACK, MAX_JUMP = 887272, 100, 1e6


def word(data: Column, n: int) -> Column:
    """The n-th 32-byte word of 0x-prefixed hex; null where the data end before it."""
    found = F.lower(F.substring(data, 3 + 64 * n, 64))
    return F.when(F.char_length(found) == 64, found)


def unsigned(hex_word: Column) -> Column:
    """A word as a double, summed from its four 64-bit limbs (conv reads 64 bits without sign)."""
    limb = lambda k: F.conv(F.substring(hex_word, 1 + 16 * k, 16), 16, 10).cast("double") * 2.0 ** (64 * (3 - k))
    return limb(0) + limb(1) + limb(2) + limb(3)


def is_zero(hex_word: Column) -> Column:
    return hex_word == "0" * 64


def signed(hex_word: Column, may: Column | None = None) -> Column:
    """A word in two's complement as a double, where `may` holds; the complement is taken in hex, so small negatives are exact."""
    below = F.substring(hex_word, 1, 1) >= "8"
    below = below if may is None else below & may
    size = F.when(below, F.translate(hex_word, "0123456789abcdef", "fedcba9876543210")).otherwise(hex_word)
    return unsigned(size) * F.when(below, -1.0).otherwise(1.0) - F.when(below, 1.0).otherwise(0.0)


def clean_logs(logs: DataFrame, stream: str = "token") -> DataFrame:
    """Logs that weren't removed, each (stream, block, log_index) once; of different repeats the least row stays."""
    place = [stream, "block", "log_index"]
    rest = [c for c in logs.columns if c not in (*place, "removed")]
    return logs.where(~F.coalesce("removed", F.lit(False))).groupBy(*place).agg(F.min(F.struct(*rest)).alias("_log")).select(*place, "_log.*")


def log_counts(logs: DataFrame, stream: str = "token") -> DataFrame:
    """Rows, removed rows, repeats and rows without usable data of each stream."""
    removed = F.coalesce("removed", F.lit(False))
    places = logs.groupBy(stream, "block", "log_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(removed).alias("gone"), F.count_if(~removed & word(F.col("data"), 0).isNull()).alias("bad"))
    return places.groupBy(stream).agg(
        F.sum("n").alias("n_logs"), F.sum("gone").alias("n_removed"), F.sum(F.greatest(F.col("n") - F.col("gone") - 1, F.lit(0))).alias("n_repeats"), F.sum("bad").alias("n_bad")
    )


def decode_pool_events(logs: DataFrame) -> DataFrame:
    """logs with price (token in quote units; null if none), liq_q (quote side), liq_known, drained, tok_delta and quo_delta.

    Of v2 events the reserves come as exact words too (tok_word, quo_word), so that they can be subtracted.
    Needs kind (v2, v3, v4, curve), event (buy or sell of a curve), token_is_0, token_dec, quote_dec and data. A drained
    pool has no price; a curve has no known liquidity. Words that are missing give nulls, never a drain.
    """
    is0, v2, curve, swap = F.col("token_is_0"), F.col("kind") == "v2", F.col("kind") == "curve", F.col("kind").isin("v3", "v4")
    words = logs.withColumns({f"_w{n}": word(F.col("data"), n) for n in range(5)})
    mine, other = F.when(is0 | curve, F.col("_w0")).otherwise(F.col("_w1")), F.when(is0 | curve, F.col("_w1")).otherwise(F.col("_w0"))
    numbers = words.withColumns({  # of a curve: amounts, fee and tax; of a swap: amounts, root of the price, depth and tick
        "_a": signed(mine, swap),
        "_b": signed(other, swap),
        "_c": unsigned(F.col("_w2")) / F.when(swap, 2.0**96).otherwise(1.0),
        "_d": unsigned(F.col("_w3")),
        "_tick": F.when(swap, signed(F.col("_w4"))),
        "_units": F.pow(F.lit(10.0), F.col("quote_dec")),
        "_decimals": F.pow(F.lit(10.0), F.col("token_dec") - F.col("quote_dec")),
    })
    a, b, c, depth, buy, sell = F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d"), F.col("event") == "buy", F.col("event") == "sell"
    quote = F.when(buy, a).when(sell, b) + F.when(buy, -1.0).otherwise(1.0) * (c + depth)
    in_range = F.when(depth > 0, F.when(is0, depth * c).otherwise(depth / c)).otherwise(0.0)
    gone = F.when(v2, (a == 0) | (b == 0)).when(swap, (depth == 0) | (c == 0) | (F.abs("_tick") >= MAX_TICK - TICK_SLACK))
    found = numbers.withColumns({
        "_quote": F.when(curve, quote),
        "_tokens": F.when(curve, F.when(buy, b).when(sell, a)),
        "drained": F.coalesce(gone, F.lit(False)),
        "liq_q": F.when(v2, b).when(swap & F.col("_tick").isNotNull(), F.when(c > 0, in_range).otherwise(0.0)) / F.col("_units"),
    })
    # each price by one fixed sequence of roundings: powers of c and amounts in whole units come first
    square = F.when(is0, c * c).otherwise(1.0 / (c * c))
    price = F.when(v2, F.try_divide(b, a) * F.col("_decimals")).when(swap & (c > 0), square * F.col("_decimals"))
    price = price.when((F.col("_quote") > 0) & (F.col("_tokens") > 0), F.col("_quote") / F.col("_units") / (F.col("_tokens") / F.pow(F.lit(10.0), F.col("token_dec"))))
    return found.select(
        *logs.columns, "drained", F.col("liq_q").isNotNull().alias("liq_known"), "liq_q", F.when(~F.col("drained"), price).alias("price"),
        F.when(curve, F.col("_tokens")).otherwise(a).alias("tok_delta"), F.when(curve, F.when(buy, a).otherwise(F.col("_quote"))).otherwise(b).alias("quo_delta"),
        F.when(v2, mine).alias("tok_word"), F.when(v2, other).alias("quo_word"),
    )


def trades(events: DataFrame, stream: str = "token") -> DataFrame:
    """Events that are trades, with buy and vol (quote units). v2 reserves are compared with the event before, as whole numbers of 256 bits.

    Not trades: the first v2 event of a stream, deltas of zero, v2 deltas of one sign (liquidity), curve ends.
    """
    order = Window.partitionBy(stream).orderBy("block", "log_index")
    v2 = F.col("kind") == "v2"
    before = events.withColumns({"_tok_before": F.lag("tok_word").over(order), "_quo_before": F.lag("quo_word").over(order)})
    tok = F.when(v2, compared(F.col("tok_word"), F.col("_tok_before")).cast("double")).otherwise(F.col("tok_delta"))  # its sign is what counts
    quo = F.when(v2, difference(F.col("quo_word"), F.col("_quo_before"))).otherwise(F.col("quo_delta"))
    moved = before.withColumns({"_tok": tok, "_quo": quo})
    buy = F.when(F.col("kind") == "curve", F.col("event") == "buy").when(F.col("kind") == "v4", F.col("_tok") > 0).otherwise(F.col("_tok") < 0)
    swap = (F.col("_tok") != 0) & (~v2 | (F.signum("_tok") == -F.signum("_quo")))
    return moved.where(swap).withColumns({"buy": buy, "vol": F.abs("_quo") / F.pow(F.lit(10.0), F.col("quote_dec"))}).drop("_tok", "_quo", "_tok_before", "_quo_before")


def rug_flag(quote_usd: Column, least_usd: float) -> Column:
    """Drained, or the quote side is known to be under the threshold. Without a price of the quote only zero is known."""
    usd = F.when(F.col("liq_known") & (F.col("liq_q") == 0), 0.0).when(F.col("liq_known") & (quote_usd > 0), F.col("liq_q") * quote_usd)
    return F.col("drained") | F.coalesce((usd < least_usd) & F.lit(least_usd > 0), F.lit(False))


def until_rug(events: DataFrame, rug: Column, stream: str = "token") -> DataFrame:
    """Events before the first rug of their stream, in order of block and log."""
    first = events.where(rug).groupBy(stream).agg(F.min(F.struct("block", "log_index")).alias("_rug"))
    joined = events.join(first, stream, "left")
    return joined.where(F.col("_rug").isNull() | (F.struct("block", "log_index") < F.col("_rug"))).drop("_rug")


def plausible(events: DataFrame, entries: DataFrame, stream: str = "token") -> DataFrame:
    """Events whose price is at most MAX_JUMP times the entry price; all where there is no entry price."""
    joined = events.join(entries.select(stream, F.col("entry_price").alias("_entry")), stream, "left")
    return joined.where(~F.coalesce((F.col("_entry") > 0) & (F.col("price") > F.col("_entry") * MAX_JUMP), F.lit(False))).drop("_entry")


def stitch_graduated(events: DataFrame, ends: DataFrame, stream: str = "token") -> DataFrame:
    """Curve events up to the block in which the curve closed, pool events from there on; without an end the curve only."""
    joined = events.join(ends.select(stream, F.col("closed_block").alias("_closed")), stream, "left")
    on_curve = F.col("kind") == "curve"
    return joined.where((on_curve & (F.col("_closed").isNull() | (F.col("block") <= F.col("_closed")))) | (~on_curve & (F.col("block") >= F.col("_closed")))).drop("_closed")


def feed_asof(requests: DataFrame, answers: DataFrame, key: str, request_time: str, lookback_us: int, name: str) -> DataFrame:
    """requests with `name`: the last positive answer (key, t, seq, answer) at or before their time within the look-back.

    A key is cut into slices of time as long as the look-back, and an answer counts in its own and the next one: an
    asset that most requests name is spread over its slices.
    """
    piece = lambda t: F.floor(t / F.lit(lookback_us)).cast("long")
    usable = answers.where("answer > 0")
    slices = F.explode(F.array(piece(F.col("t")), piece(F.col("t")) + 1)).alias("n")
    spread = usable.select(key, slices, F.col("t").alias("_answered"), F.col("seq").alias("_seq"), F.col("answer").alias("_answer"))
    spread = spread.select(F.struct(F.col(key).alias("k"), "n").alias("_at"), "_answered", "_seq", "_answer")
    asked = requests.withColumn("_at", F.struct(F.col(key).alias("k"), piece(F.col(request_time)).alias("n")))
    found = as_of(asked, spread, "_at", request_time, "_answered", ["_answered", "_answer"], "_seq")
    return found.withColumn(name, F.when(F.col("_answered") >= F.col(request_time) - lookback_us, F.col("_answer"))).drop("_at", "_answered", "_answer")


def pick_pool(pools: DataFrame, calls: DataFrame, token: str, slack_s: int = 300) -> DataFrame:
    """token, pool and reserve: the most liquid pool made by five minutes after the call, else the most liquid."""
    joined = pools.join(calls.select(token, "call_s"), token)
    place = F.struct((F.col("created_s") <= F.col("call_s") + slack_s).alias("existed"), "reserve", "pool")
    return joined.groupBy(token).agg(F.max(place).alias("p")).select(token, "p.pool", "p.reserve", "p.existed")


def counterparties(transfers: DataFrame, first_block: int, last_block: int) -> DataFrame:
    """Addresses that send or receive in a window of blocks, with the number of their transfers."""
    inside = transfers.where(F.col("block").between(first_block, last_block))
    return inside.select(F.explode(F.array("sender", "receiver")).alias("address")).where("address is not null").groupBy("address").agg(F.count(F.lit(1)).alias("n"))


def decode_liquidity(logs: DataFrame) -> DataFrame:
    """logs with lp: add, remove or collect. A v3 burn of nothing is a collect; a v4 change counts by its sign.

    The words are cut out by a generator of one row, so that no later use or filter of lp evaluates the log's data again.
    """
    cut = logs.withColumn("_words", F.explode(F.array(F.struct(word(F.col("data"), 0).alias("w0"), word(F.col("data"), 2).alias("w2")))))
    w0, w2 = F.col("_words.w0"), F.col("_words.w2")
    mint, burn, collect = (F.col("event") == x for x in ("mint", "burn", "collect"))
    change = F.when(is_zero(w2), "collect").when(F.substring(w2, 1, 1) >= "8", "remove").when(w2.isNotNull(), "add")
    lp = (
        F.when((F.col("protocol") == "v4") & (F.col("event") == "modify"), change)
        .when(mint, "add").when((F.col("protocol") == "v3") & burn & is_zero(w0), "collect").when(burn, "remove").when((F.col("protocol") == "v3") & collect, "collect")
    )
    return cut.withColumn("lp", lp).drop("_words").where("lp is not null")


def liquidity_txs(events: DataFrame) -> DataFrame:
    """Which kinds of liquidity event each transaction on a venue has; events without a transaction are left out."""
    return events.where("tx is not null and tx <> ''").groupBy("venue", "tx").agg(*[F.bool_or(F.col("lp") == k).alias(f"has_{k}") for k in ("add", "remove", "collect")])


def liquidity_stats(events: DataFrame, transfers: DataFrame, deployers: DataFrame, entries: DataFrame, token: str = "token") -> DataFrame:
    """Adds, removals and collects up to the entry block, removal strictly before it, and whether the deployer was paid in one.

    deployer_removed: a positive transfer to the deployer, up to the entry block, in a transaction with a removal; null
    where the deployer is unknown. Events and transfers go to their token once, transactions are told apart there.
    """
    known = deployers.where("deployer is not null").groupBy(token).agg(F.collect_set("deployer").alias("_deployers"))
    asked = entries.select(token, "entry_block").join(known.hint("merge"), token, "left")
    nobody = F.lit(None).cast(transfers.schema["receiver"].dataType)
    moves = events.select(token, "tx", "block", "lp", nobody.alias("receiver")).unionByName(
        transfers.where("value > 0 and receiver is not null and tx is not null and tx <> ''").select(token, "tx", "block", F.lit(None).cast("string").alias("lp"), "receiver")
    )
    met = moves.join(asked.hint("merge"), token).where(F.col("block") <= F.col("entry_block"))
    met = met.where(F.col("lp").isNotNull() | F.array_contains("_deployers", F.col("receiver")))
    removal = F.col("lp") == "remove"
    txs = met.groupBy(token, "tx").agg(
        *[F.count_if(F.col("lp") == k).alias(n) for k, n in (("add", "adds"), ("remove", "removes"), ("collect", "collects"))],
        F.count("lp").alias("_n"), F.bool_or(removal & (F.col("block") < F.col("entry_block"))).alias("_before"),
        F.bool_or(F.col("receiver").isNotNull()).alias("_paid"), F.bool_or(F.col("_deployers").isNotNull()).alias("_known"),
    )
    stats = txs.groupBy(token).agg(
        *[F.sum(n).alias(n) for n in ("adds", "removes", "collects", "_n")], F.bool_or("_before").alias("removed_before_entry"),
        F.coalesce(F.bool_or(F.col("_paid") & (F.col("removes") > 0) & (F.col("tx") != "")), F.lit(False)).alias("_paid"), F.bool_or("_known").alias("_known"),
    )
    return stats.where("_n > 0").select(token, "adds", "removes", "collects", "removed_before_entry", F.when(F.col("_known"), F.col("_paid")).alias("deployer_removed"))


def block_times(events: DataFrame, known: DataFrame, stream: str, block: str = "block") -> DataFrame:
    """events with t_est: the time of their block, on the line between the known blocks around it (null outside them)."""
    order, pair = known.withColumn("_seq", F.col("known_block")), ["known_block", "known_t"]
    before = as_of(events, order, stream, block, "known_block", pair, "_seq").withColumnsRenamed({"known_block": "_b0", "known_t": "_t0"})
    both = as_of(before, order, stream, block, "known_block", pair, "_seq", forward=True)
    share = F.try_divide(F.col(block) - F.col("_b0"), F.col("known_block") - F.col("_b0"))
    t = F.when(F.col("_b0") == F.col("known_block"), F.col("_t0").cast("double")).otherwise(F.col("_t0") + share * (F.col("known_t") - F.col("_t0")))
    return both.withColumn("t_est", t).drop("_b0", "_t0", *pair)

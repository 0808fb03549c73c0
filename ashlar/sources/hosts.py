"""Hosts that must not be asked: by their name, by the names they are aliases of, or by the addresses they resolve to. Lists of any size are joined; nothing is broadcast or crossed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions.scalars import c
from ashlar.tables import cut, skew_join

_BITS = 32


def plain_host(host) -> Column:
    """A host in lower case without the dot that ends a full name; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c(host))), r"\.+$", ""), F.lit(""))


def suffixes_of(host: Column) -> Column:
    """A name and all names above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def longest_suffix(names: DataFrame, key: str, name: str, listed: DataFrame) -> DataFrame:
    """key, suffix, label: of each row of names the longest of the listed suffixes (suffix, label) that its name is or ends with, label by label. Rows without one, and null names, are left out.

    A name of n labels is looked up n times. A suffix that a third of all names have (a top-level domain that is listed, say) is no one task's. Of a suffix that is listed twice the
    smaller label counts; rows that share a key each count.
    """
    each = names.select(F.col(key).alias("k"), plain_host(name).alias("host")).where("host IS NOT NULL").select("k", F.monotonically_increasing_id().alias("row"), F.explode(suffixes_of(F.col("host"))).alias("suffix"))
    each = cut(each)
    known = listed.select(plain_host("suffix").alias("suffix"), "label").where("suffix IS NOT NULL").groupBy("suffix").agg(F.min("label").alias("label"))
    used = cut(each.groupBy("suffix").agg(F.count("*").alias("n")).join(known, "suffix"))
    total = used.agg(F.sum("n")).first()[0] or 0
    hits = skew_join(each, used, ["suffix"], "n", total).where("label IS NOT NULL")
    best = hits.groupBy("row").agg(F.max_by(F.struct("k", "suffix", "label"), F.length("suffix")).alias("b"))
    return best.select(F.col("b.k").alias(key), "b.suffix", "b.label")


def address_number(address) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(c(address), r"\.")
    bytes_ = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.try_cast("long")))
    good = (F.size(parts) == 4) & F.forall(bytes_, lambda b: F.coalesce(b <= 255, F.lit(False)))
    return F.when(good, F.aggregate(bytes_, F.lit(0).cast("long"), lambda a, b: a * 256 + b))


def aligned_blocks(first: Column, last: Column) -> Column:
    """A range of numbers as the fewest blocks of 2^bits numbers that begin at a multiple of 2^bits: array of start and bits, at most 62 for addresses."""
    block = "array<struct<start:bigint,bits:int>>"

    def step(a: Column, k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("long")
        odd = lambda x: F.pmod(F.floor(x / size).cast("long"), F.lit(2)) == 1
        open_ = a["l"] < a["r"]
        left = open_ & odd(a["l"])
        l_ = F.when(left, a["l"] + size).otherwise(a["l"])
        right = (l_ < a["r"]) & odd(a["r"])
        r_ = F.when(right, a["r"] - size).otherwise(a["r"])
        one = lambda start: F.array(F.struct(start.alias("start"), k.cast("int").alias("bits"))).cast(block)
        out = F.concat(a["out"], F.when(left, one(a["l"])).otherwise(F.array().cast(block)), F.when(right, one(r_)).otherwise(F.array().cast(block)))
        return F.struct(l_.alias("l"), r_.alias("r"), out.alias("out"))

    start = F.struct(first.cast("long").alias("l"), (last + 1).cast("long").alias("r"), F.array().cast(block).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_BITS)), start, step, lambda a: a["out"])


def narrowest_range(addresses: DataFrame, key: str, address: str, ranges: DataFrame) -> DataFrame:
    """key, address, label: of each address the narrowest of the ranges (first, last: addresses, both included; label) that it is in; of equally narrow ones the smaller label. Addresses in none are left out, as is
    what isn't IPv4; a range whose ends are the wrong way round is empty.

    Ranges are cut into aligned blocks, and an address is in a block if they agree in the block's upper bits: a join of equals, over the lengths that blocks have (33 at most). A block that holds very many
    addresses is no one task's.
    """
    r = ranges.select(address_number("first").alias("f"), address_number("last").alias("l"), "label").where("f <= l")
    blocks = cut(r.select("label", (F.col("l") - F.col("f")).alias("wide"), F.explode(aligned_blocks(F.col("f"), F.col("l"))).alias("b")).select("label", "wide", F.col("b.bits").alias("bits"), (F.col("b.start") / F.pow(F.lit(2.0), F.col("b.bits"))).cast("long").alias("upper")))
    lengths = [x["bits"] for x in blocks.select("bits").distinct().collect()]  # at most 33
    best = blocks.groupBy("bits", "upper").agg(F.min(F.struct("wide", "label")).alias("b")).select("bits", "upper", "b.wide", "b.label")
    a = addresses.select(F.col(key).alias("k"), F.col(address).alias("address"), address_number(address).alias("x")).where("x IS NOT NULL")
    looked = F.array(*(F.struct(F.lit(n).alias("bits"), F.floor(F.col("x") / F.lit(2**n)).cast("long").alias("upper")) for n in sorted(lengths))).cast("array<struct<bits:int,upper:bigint>>")
    numbered = a.select("k", "address", "x", F.monotonically_increasing_id().alias("row"))  # before the rows are multiplied
    each = cut(numbered.select("k", "address", "row", F.explode(looked).alias("p")).select("k", "address", "row", "p.bits", "p.upper"))
    used = cut(each.groupBy("bits", "upper").agg(F.count("*").alias("n")).join(best, ["bits", "upper"]))
    total = used.agg(F.sum("n")).first()[0] or 0
    hits = skew_join(each, used, ["bits", "upper"], "n", total).where("label IS NOT NULL")
    g = hits.groupBy("row").agg(F.min(F.struct("wide", "label", "k", "address")).alias("b"))
    return g.select(F.col("b.k").alias(key), "b.address", "b.label")


def blocked_hosts(hosts: DataFrame, host: str, resolved: DataFrame, names: DataFrame, aliases: DataFrame, ranges: DataFrame) -> DataFrame:
    """host, by, label, via: the hosts that mustn't be asked, each once, and what tells: its name (by `name`), else the first of the names it stands for (`alias`), else the first of its addresses (`address`).

    resolved: host, names (array, the canonical one first), addresses (array). names and aliases: suffix, label; ranges: first, last, label. Hosts are compared in lower case, without a last dot. A host that isn't
    resolved is judged by its name alone. Null hosts are left out.
    """
    asked = cut(hosts.select(plain_host(host).alias("h")).where("h IS NOT NULL").distinct())
    known = resolved.select(plain_host("host").alias("h"), "names", "addresses").join(asked, "h", "left_semi")
    by_name = longest_suffix(asked, "h", "h", names).select("h", F.lit(0).alias("o"), F.lit(0).alias("pos"), F.lit("name").alias("by"), "label", F.col("h").alias("via"))
    other = known.select("h", F.posexplode("names").alias("pos", "via")).select(F.struct("h", "pos", "via").alias("k"), "via")
    by_alias = longest_suffix(other, "k", "via", aliases).select("k.h", F.lit(1).alias("o"), "k.pos", F.lit("alias").alias("by"), "label", plain_host(F.col("k.via")).alias("via"))
    at = known.select("h", F.posexplode("addresses").alias("pos", "via")).select(F.struct("h", "pos").alias("k"), "via")
    by_address = narrowest_range(at, "k", "via", ranges).select("k.h", F.lit(2).alias("o"), "k.pos", F.lit("address").alias("by"), "label", F.col("address").alias("via"))
    found = by_name.unionByName(by_alias).unionByName(by_address)
    first = found.groupBy("h").agg(F.min(F.struct("o", "pos", "via", "label", "by")).alias("b"))
    return first.select(F.col("h").alias(host), "b.by", "b.label", "b.via")

"""Matching entities across sources without keys, by soft logic.

Lines of orders and entries of rate schedules describe the same articles in different
words. Candidate pairs share an article code or a measure, and their parties' names must
not contradict each other. Each order is then a small hinge-loss Markov random field over
truth values in [0, 1]: ``match(line, entry)`` and ``party(order, party)``, with weighted rules

    alike(line, entry)                         -> match(line, entry)
    match(line, entry)                         -> alike(line, entry)
    named(order, party)                        -> party(order, party)        and back
    match(line, entry) & offers(party, entry)  -> party(order, party)        (transitivity)
    party(order, party) & alike(line, entry)   -> match(line, entry)
    at most one entry per line, one party per order                          (exclusivity)

The most probable state is a convex problem and is solved by the alternating direction
method of multipliers: every rule keeps its own copies of its atoms, solves its part in
closed form, and the copies are averaged. Orders share no atoms, so they are solved where
they lie, many of them as one set of vectors. The value of a match is its confidence.

Defined cases: a null or blank vendor may be any party; lines without any text, and lines
that share neither code nor measure with an entry, have no match; a null price or unit
speaks neither for nor against; orders and contracts delivered again count once; equal
values go to the entry with the nearer price, then to the smaller contract and position;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.similarity import bigrams, dice, name_bigrams, name_similarity, overlap
from tallyfold.sources.tables import by_key

# Units of measure in several languages, and units of measures with their factor to a base.
UNITS = {
    "EA": ("ea", "each", "pcs", "pc", "pce", "piece", "pieces", "st", "stk", "stück", "kpl", "pièce", "unit"),
    "SET": ("set", "satz", "sarja", "sats", "jeu", "kit"),
    "M": ("m", "mtr", "meter", "metre", "metri"),
    "KG": ("kg", "kilo", "kgs", "kilogram"),
    "L": ("l", "ltr", "liter", "litre", "litra"),
    "DAY": ("day", "days", "tag", "tage", "pv", "päivä", "dag", "jour"),
    "H": ("h", "hr", "hour", "std", "tunti", "tim"),
}
MEASURES = {
    "mm": ("mm", 1.0), "cm": ("mm", 10.0), "m": ("mm", 1000.0), "g": ("g", 1.0), "kg": ("g", 1000.0), "t": ("g", 1e6),
    "ml": ("ml", 1.0), "cl": ("ml", 10.0), "l": ("ml", 1000.0), "w": ("w", 1.0), "kw": ("w", 1000.0), "mbar": ("bar", 0.001), "bar": ("bar", 1.0),
}

_MEASURE = rf"(?<![\d.,])(\d+(?:[.,]\d+)?)\s*({'|'.join(sorted(MEASURES, key=len, reverse=True))})(?![\p{{L}}\d])"
#: An article code: a few letters, then figures, joined or with one mark between, that is no measure.
_CODE = rf"(?<![\p{{L}}\d])([a-z]{{2,3}})[-/ .]?(\d{{3,5}})(?!\d)(?!\s*(?:{'|'.join(sorted(MEASURES, key=len, reverse=True))})(?![\p{{L}}\d]))"

#: Weights of the rules.
W_ALIKE, W_UNLIKE, W_NAMED, W_TRANSITIVE, W_PARTY = 1.0, 1.0, 20.0, 10.0, 0.5
#: A match counts from this truth value on.
ACCEPT = 0.4
#: Names whose letter pairs overlap less than this contradict each other.
NAME_MAY_AGREE = 0.5


def _unit(unit: Column) -> Column:
    low = F.lower(F.trim(unit))
    out = F.when(F.length(low) > 0, F.upper(low))
    for canonical, spellings in UNITS.items():
        out = F.when(low.isin(*spellings), F.lit(canonical)).otherwise(out)
    return out


def described(description: Column) -> Column:
    """struct(code, measure, words) of an article's description."""
    low = F.lower(description)
    code = F.concat(F.regexp_extract(low, _CODE, 1), F.regexp_extract(low, _CODE, 2))
    size = F.regexp_replace(F.regexp_extract(low, _MEASURE, 1), ",", ".").try_cast("double")
    of = F.regexp_extract(low, _MEASURE, 2)
    base, factor = F.lit(None).cast("string"), F.lit(None).cast("double")
    for u, (b, f) in MEASURES.items():
        base, factor = F.when(of == u, F.lit(b)).otherwise(base), F.when(of == u, F.lit(f)).otherwise(factor)
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, _CODE, " "), _MEASURE, " "), r"[^\p{L}]+", " "))
    return F.struct(
        F.when(F.length(code) > 0, code).alias("code"),
        F.concat_ws(":", base, F.round(size * factor, 3).cast("decimal(18,3)").cast("string")).alias("measure"),
        words.alias("words"),
    )


def order_lines(orders: DataFrame, has_contract: Column, key: str = "document_id") -> DataFrame:
    """(po_id, line_pos, vendor, vendor_pairs, code, measure, words, unit, price) of the orders without a contract, each order once."""
    asked = orders.where(F.col(key).isNotNull() & ~F.coalesce(has_contract, F.lit(False))).select(F.col(key).alias("po_id"), "vendor.name", "lines", "ingested_at", "row_id")
    first = by_key(asked, "po_id").groupBy("po_id").agg(F.min_by(F.struct("name", "lines"), F.struct("ingested_at", "row_id")).alias("o"))
    lines = first.select("po_id", F.col("o.name").alias("vendor"), name_bigrams(F.col("o.name")).alias("vendor_pairs"), F.posexplode("o.lines").alias("pos", "l"))
    return lines.select(
        "po_id", (F.col("pos") + 1).alias("line_pos"), F.when(F.col("vendor_pairs").isNotNull(), F.col("vendor")).alias("vendor"), "vendor_pairs",
        described(F.col("l.description")).alias("d"), _unit(F.col("l.unit_of_measure")).alias("unit"), F.col("l.unit_price").alias("price"),
    ).select("po_id", "line_pos", "vendor", "vendor_pairs", "d.code", "d.measure", "d.words", "unit", "price")


def schedule_entries(contracts: DataFrame, key: str = "document_id") -> DataFrame:
    """(contract_id, rate_pos, party, party_pairs, code, measure, words, unit, ceiling), each contract once."""
    first = contracts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("contract_id")).agg(F.min_by(F.struct("counterparty.name", "rate_schedule"), F.struct("ingested_at", "row_id")).alias("c"))
    return (
        first.select("contract_id", F.col("c.name").alias("party"), name_bigrams(F.col("c.name")).alias("party_pairs"), F.posexplode("c.rate_schedule").alias("pos", "e"))
        .select("contract_id", (F.col("pos") + 1).alias("rate_pos"), "party", "party_pairs", described(F.col("e.description")).alias("d"), _unit(F.col("e.unit_of_measure")).alias("unit"), F.col("e.max_unit_price").alias("ceiling"))
        .select("contract_id", "rate_pos", "party", "party_pairs", "d.code", "d.measure", "d.words", "unit", "ceiling")
    )


def wordings(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(words, family, worded): likeness of a line's words to the likest wording of the articles whose codes begin with the same letters.

    Distinct words of lines and of entries only, of one family; the most is taken before the shuffle.
    """
    family = F.regexp_extract("code", r"^\D+", 0).alias("family")
    names = entries.where("code is not null and words <> ''").select(family, F.col("words").alias("name")).distinct()
    asked = candidate_words(lines, entries)

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_wording(x, y) for x, y in zip(a, b)], dtype="float64")

    return asked.join(names, "family").groupBy("words", "family").agg(F.max(like("words", "name")).alias("worded"))


def _family(code: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(code, F.lit("")), r"^\D+", 0), F.lit(""))


def candidate_words(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct (words, family) of lines and the entries that share a block with them."""
    blocks = lambda df: F.explode(F.array_compact(F.array("code", F.nullif("measure", F.lit(""))))).alias("block")
    asked = lines.where("words <> ''").select("words", blocks(lines)).distinct()
    offered = entries.where("code is not null").select(_family("code").alias("family"), blocks(entries)).distinct()
    return asked.join(offered, "block").select("words", "family").distinct()


def likest_party(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(vendor, best_name): likeness of each distinct vendor's name to the likest of all parties.

    Names are compared where a word of one begins like a word of the other.
    """
    keys = lambda c: F.explode(F.array_distinct(F.transform(F.split(F.lower(F.split_part(c, F.lit(","), F.lit(1))), r"[^\p{L}\p{N}]+"), lambda w: F.left(w, F.lit(3))))).alias("start")

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([name_similarity(x, y) for x, y in zip(a, b)], dtype="float64")

    vendors = lines.where("vendor is not null").select("vendor").distinct()
    parties = entries.where("party_pairs is not null").select("party").distinct()
    pairs = vendors.select("vendor", keys(F.col("vendor"))).join(parties.select("party", keys(F.col("party"))), "start").where("start <> ''").select("vendor", "party").distinct()
    return pairs.groupBy("vendor").agg(F.max(like("vendor", "party")).alias("best_name"))


def candidates(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs that share a code, or a measure where one side has no code, and whose names don't contradict each other.

    Two different codes are two articles. The join is on one block key per line and up to
    two per entry; entries are the smaller side and Spark broadcasts them only while they
    are under its own threshold.
    """
    left = lines.withColumn("block", F.coalesce("code", "measure")).where("block <> ''")
    code = entries.where("code is not null").withColumn("block", F.col("code"))
    measure = entries.where("measure <> ''").withColumn("block", F.col("measure"))
    # a line with a code meets entries without one through its measure
    bare = lines.where("code is not null and measure <> ''").withColumn("block", F.col("measure"))
    e = lambda df: df.select("block", *(F.col(c).alias(f"e_{c}") for c in ("code", "measure", "words", "unit")), "contract_id", "rate_pos", "party", "party_pairs", "ceiling")
    may_agree = F.coalesce(overlap(F.col("vendor_pairs"), F.col("party_pairs")) >= NAME_MAY_AGREE, F.lit(True))
    pairs = left.join(e(code.unionByName(measure)), "block").unionByName(bare.join(e(measure.where("code is null")), "block"))
    return pairs.where(may_agree & (F.col("code").isNull() | F.col("e_code").isNull() | (F.col("code") == F.col("e_code")))).drop("vendor_pairs", "party_pairs", "block")


@lru_cache(maxsize=200_000)
def _wording(words: str, name: str) -> float:
    return max(dice(words, name), 0.95 * _contained(words, name)) if words else 0.0


@lru_cache(maxsize=500_000)
def _contained(words: str, name: str) -> float:
    """How much of the shorter text's letter pairs the other has: for added or dropped words."""
    a, b = bigrams(words), bigrams(name)
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def alike(line: dict, entry: dict) -> float:
    """Truth of "line and entry describe the same article at that price", from the evidence of each attribute."""
    words = max(_wording(line["words"] or "", entry["e_words"] or ""), entry["worded"] or 0.0)
    same_measure = None if not line["measure"] or not entry["e_measure"] else line["measure"] == entry["e_measure"]
    if line["code"] is not None and entry["e_code"] is not None:
        s = 0.85 + 0.15 * words  # candidates with two different codes are not formed
    else:
        s = (0.35 + 0.6 * words) if same_measure else 0.4 * words
    if same_measure is False:
        s *= 0.5
    if line["unit"] is not None and entry["e_unit"] is not None and line["unit"] != entry["e_unit"]:
        s *= 0.75
    at = priced(line, entry)
    if at is False:
        # a known vendor may charge something else than the ceiling; for any other it is the main evidence
        s *= 0.75 if line["vendor"] is not None else 0.4
    return min(1.0, s)


def priced(line: dict, entry: dict) -> bool | None:
    """Whether the price is about the ceiling, which is what is mostly charged; None if either is missing."""
    price, ceiling = line["price"], entry["ceiling"]
    if price is None or ceiling is None or price <= 0 or ceiling <= 0:
        return None
    return 0.975 <= price / ceiling <= 1.025


#: Residual at which an order counts as solved, how often it is looked at, and the rounds after which an order is given up as not converged.
TOLERANCE, LOOK_EVERY, MOST_ROUNDS = 1e-6, 10, 20_000
#: Penalty on copies that differ; of the order of the weights, so that stiff rules settle as fast as soft ones.
PENALTY = 15.0
#: How much further than its own solution each part steps.
RELAX = 0.7


def solve(n_atoms: int, linear: tuple, groups: tuple, block: np.ndarray | None = None, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE, rho: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(truth values, converged) that minimise the weighted hinge losses under the exclusivity constraints.

    linear: (i, a, j, b, c, w) arrays, losses w * max(0, a x_i + b x_j + c)^2, j = -1 for
    losses of one atom; groups: (atom, group, n_groups), sum of the atoms of a group at most 1.
    block: number of the problem that an atom belongs to, ascending; atoms, losses and groups
    of a problem stand together. Each problem stops on its own primal and dual residual, so
    that its values don't depend on the others it is solved with.
    """
    i, a, j, b, c, w = linear
    atom, group, _ = groups
    block = np.zeros(n_atoms, np.int64) if block is None else block
    n_blocks = int(block[-1]) + 1 if n_atoms else 0
    out, converged = np.full(n_atoms, 0.5), np.zeros(n_blocks, bool)
    live = np.arange(n_atoms)  # atoms of the problems that are still open
    z = np.full(n_atoms, 0.5)
    ui, uj, ug = np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(atom))
    k = 0
    while len(live) and k < rounds:
        n = len(live)
        one = j < 0
        b_, jj = np.where(one, 0.0, b), np.where(one, i, j)
        degree = np.maximum(np.bincount(i, minlength=n) + np.bincount(jj, weights=~one, minlength=n) + np.bincount(atom, minlength=n), 1)
        _, group_ = np.unique(group, return_inverse=True)
        size = np.bincount(group_)
        norm = a * a + b_ * b_
        of = np.cumsum(np.diff(block[live], prepend=-1) != 0) - 1  # problem of each live atom, counted from 0
        names = block[live][np.flatnonzero(np.diff(block[live], prepend=-1))]
        starts = [np.searchsorted(x, np.arange(len(names))) for x in (of, of[i], of[atom])]
        most = lambda x, at: np.maximum.reduceat(np.abs(x), np.minimum(at, len(x) - 1)) if len(x) else 0.0
        done = np.zeros(len(names), bool)
        while not done.any() and k < rounds:
            # every rule solves its part for its own copies
            xi, xj = z[i] - ui, z[jj] - uj
            loss = a * xi + b_ * xj + c
            step = np.where(loss > 0, (2 * w / rho) * loss / (1 + (2 * w / rho) * norm), 0.0)
            xi, xj = xi - step * a, xj - step * b_
            xg = z[atom] - ug
            over = np.maximum(np.bincount(group_, weights=xg) - 1.0, 0.0) / size
            xg = xg - over[group_]
            # a step further than the solution of each part, which settles in fewer rounds
            xi, xj, xg = xi + RELAX * (xi - z[i]), xj + RELAX * (xj - z[jj]), xg + RELAX * (xg - z[atom])
            # the copies are averaged
            total = np.bincount(i, weights=xi + ui, minlength=n) + np.bincount(jj, weights=np.where(one, 0.0, xj + uj), minlength=n) + np.bincount(atom, weights=xg + ug, minlength=n)
            new = np.clip(total / degree, 0.0, 1.0)
            pi, pj, pg = xi - new[i], np.where(one, 0.0, xj - new[jj]), xg - new[atom]
            ui += pi
            uj += pj
            ug += pg
            k += 1
            if k % LOOK_EVERY == 0:
                residual = np.maximum.reduce([most(new - z, starts[0]), most(pi, starts[1]), most(pj, starts[1]), most(pg, starts[2])])
                done = residual < tolerance
            z = new
        out[live] = z
        converged[names[done]] = True
        # what is solved is taken out, so that nothing moves it any more
        stay = ~done[of]
        renumbered = np.cumsum(stay) - 1
        rule, member = stay[i], stay[atom]
        i, j, a, b, c, w, ui, uj = renumbered[i[rule]], np.where(j[rule] < 0, -1, renumbered[j[rule]]), a[rule], b[rule], c[rule], w[rule], ui[rule], uj[rule]
        atom, group, ug = renumbered[atom[member]], group[member], ug[member]
        live, z = live[stay], z[stay]
    return out, converged


def same_party(vendor: str, party: str | None, best: float | None) -> float:
    """Truth of "the vendor is this party": likeness of the names, less what it lacks to the likest of all parties."""
    like = name_similarity(vendor, party or "")
    return min(1.0, max(0.0, (like - 0.55) / 0.3 - 4 * max(0.0, (best or 0.0) - like)))


MATCHES = "po_id string, line_pos int, contract_id string, rate_pos int, confidence double, converged boolean"


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        i, a, j, b, c, w = ([] for _ in range(6))
        atoms, group = [], []
        n, g = 0, 0
        block: list[int] = []
        pairs: list[tuple] = []

        def rule(i_: int, a_: float, j_: int, b_: float, c_: float, w_: float) -> None:
            for column, x in zip((i, a, j, b, c, w), (i_, a_, j_, b_, c_, w_)):
                column.append(x)

        for o, (po_id, cands) in enumerate(zip(pdf["po_id"], pdf["cands"])):
            parties: dict[str, int] = {}
            # of an order without a vendor: how many of its lines each party offers at the price charged
            at_price: dict[str, set[int]] = {}
            for x in cands:
                if priced(x, x):
                    at_price.setdefault(x["party"], set()).add(x["line_pos"])
            asked = len({x["line_pos"] for x in cands})
            lines: dict[int, int] = {}
            party_group, g = g, g + 1
            for x in cands:
                party = x["party"] or f"\0{x['contract_id']}"
                if party not in parties:
                    named = same_party(x["vendor"], x["party"], x["best_name"]) if x["vendor"] is not None else len(at_price.get(x["party"], ())) / asked
                    parties[party] = n
                    atoms.append(n), group.append(party_group), block.append(o)
                    rule(n, -1.0, -1, 0.0, named, W_NAMED)
                    rule(n, 1.0, -1, 0.0, -named, W_NAMED)
                    n += 1
                if x["line_pos"] not in lines:
                    lines[x["line_pos"]], g = g, g + 1
                s, p = alike(x, x), parties[party]
                atoms.append(n), group.append(lines[x["line_pos"]]), block.append(o)
                rule(n, -1.0, -1, 0.0, s, W_ALIKE)
                rule(n, 1.0, -1, 0.0, -s, W_UNLIKE)
                rule(n, 1.0, p, -1.0, 0.0, W_TRANSITIVE)
                rule(p, 1.0, n, -1.0, s - 1.0, W_PARTY)
                gap = abs(x["price"] / x["ceiling"] - 1.0) if x["price"] and x["ceiling"] else 1.0
                pairs.append((po_id, x["line_pos"], x["contract_id"], x["rate_pos"], n, gap, s, o))
                n += 1
        linear = tuple(np.array(x, d) for x, d in zip((i, a, j, b, c, w), (int, float, int, float, float, float)))
        z, converged = solve(n, linear, (np.array(atoms, int), np.array(group, int), g), np.array(block, int))
        best: dict[tuple, tuple] = {}
        for po_id, line, contract, rate, k, gap, s, o in pairs:
            rank = (-round(float(z[k]), 3), -s, gap, contract, rate)
            if (po_id, line) not in best or rank < best[po_id, line][0]:
                best[po_id, line] = (rank, contract, rate, float(z[k]), bool(converged[o]))
        rows = [(po, line, contract, rate, conf, settled) for (po, line), (_, contract, rate, conf, settled) in best.items() if conf >= ACCEPT]
        yield pd.DataFrame(rows, columns=["po_id", "line_pos", "contract_id", "rate_pos", "confidence", "converged"]).astype({"line_pos": "int32", "rate_pos": "int32", "confidence": "float64", "converged": "bool"})


def link(orders: DataFrame, contracts: DataFrame, has_contract: Column) -> DataFrame:
    """(po_id, line_pos, contract_id, rate_pos, confidence, converged) of the lines of orders without a contract.

    The candidates of one order are gathered into one row: as many as its lines have
    candidates, whatever the number of orders. converged is false for an order whose problem
    was given up after ``MOST_ROUNDS`` rounds.
    """
    lines, entries = order_lines(orders, has_contract), schedule_entries(contracts)
    pairs = candidates(lines, entries).withColumn("family", _family("e_code"))
    pairs = pairs.join(likest_party(lines, entries), "vendor", "left").join(wordings(lines, entries), ["words", "family"], "left")
    fields = ["line_pos", "contract_id", "rate_pos", "vendor", "best_name", "code", "measure", "words", "unit", "price", "e_code", "e_measure", "e_words", "e_unit", "worded", "party", "ceiling"]
    by_order = by_key(pairs.select("po_id", *fields), "po_id").groupBy("po_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cands"))
    return by_order.mapInPandas(_infer, MATCHES)

"""SQL forms of the fixtures' tables, as common table expressions that name one another."""

from __future__ import annotations

import re

from ..fixtures import CONTACTS, FRAG_MULT, LENGTH, N_CHROM, PER_CHROM

RES = 100_000
PER = LENGTH // RES
NBINS = N_CHROM * PER

_edge = "(({k}) * 4000 + (({k}) * ({k}) * 37 + chrom * 101) % 1500)"
_key = "greatest(1, least(c.cuts{s} + 7 * CAST(c.strands{s} AS INTEGER) - 3, 2000000))"


def _sides(s: str) -> str:
    return ", ".join(
        [f"coalesce(f{s}.abs_idx, -1) AS rfrag{s}", f"coalesce(f{s}.len, 0) AS fraglen{s}", f"coalesce(f{s}.mid, -1) AS mid{s}", f"coalesce(f{s}.frag_id, -1) AS fragid{s}", f"coalesce(f{s}.fs, 0) AS fs{s}", f"coalesce(f{s}.fe, 0) AS fe{s}"]
    )


def _assigned(source: str) -> str:
    joins = " ".join(f"LEFT JOIN frag f{s} ON c.chrms{s} = f{s}.chrom AND {_key.format(s=s)} > f{s}.fs AND {_key.format(s=s)} <= f{s}.fe" for s in "12")
    dist = ", ".join(
        f"CAST(CASE WHEN c.chrms{s} < 0 THEN 0 WHEN c.strands{s} THEN abs(coalesce(f{s}.fe, 0) - c.cuts{s}) ELSE abs(c.cuts{s} - coalesce(f{s}.fs, 0)) END AS INTEGER) AS dists{s}" for s in "12"
    )
    far = "CAST(CASE WHEN c.chrms1 = c.chrms2 AND c.chrms1 >= 0 THEN abs(f1.mid - f2.mid) ELSE -1 END AS INTEGER) AS distance"
    return f"SELECT c.*, {_sides('1')}, {_sides('2')}, {dist}, {far} FROM {source} c {joins}"


MOLECULE = "(chrms1 = chrms2 AND chrms1 >= 0 AND strands1 <> strands2 AND (-cuts1 * (2 * CAST(strands1 AS INTEGER) - 1) - cuts2 * (2 * CAST(strands2 AS INTEGER) - 1)) BETWEEN 0 AND 500)"
VALID = f"chrms1 >= 0 AND chrms2 >= 0 AND rfrag1 <> rfrag2 AND NOT {MOLECULE}"


def _pixels(source: str, keys: str = "") -> str:
    b = [f"chrms{s} * {PER} + mid{s} // {RES}" for s in "12"]
    return (
        f"SELECT {keys}CAST(least({b[0]}, {b[1]}) AS INTEGER) AS bin1, CAST(greatest({b[0]}, {b[1]}) AS INTEGER) AS bin2, count(*) AS value "
        f"FROM {source} WHERE chrms1 >= 0 AND chrms2 >= 0 GROUP BY ALL"
    )


CTES = {
    "contacts": f"SELECT {', '.join(CONTACTS)} FROM lineitem",
    "contacts2": f"SELECT {', '.join(CONTACTS)}, CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset FROM lineitem",
    "chroms": f"SELECT CAST(c AS INTEGER) AS chrom, 'chr' || (c + 1) AS label, CAST({LENGTH} AS BIGINT) AS len, 900000 AS cntr_start, 1000000 AS cntr_end, 950000 AS cntr_mid FROM range({N_CHROM}) t(c)",
    "frag0": f"SELECT CAST(i AS INTEGER) AS abs_idx, CAST(i // {PER_CHROM} AS INTEGER) AS chrom, i % {PER_CHROM} AS k FROM range({N_CHROM * PER_CHROM}) t(i)",
    "frag1": f"SELECT abs_idx, chrom, CASE WHEN k = 0 THEN 0 ELSE {_edge.format(k='k')} END AS fs, CASE WHEN k = {PER_CHROM - 1} THEN {LENGTH} ELSE {_edge.format(k='k + 1')} END AS fe FROM frag0",
    "frag": f"SELECT abs_idx, chrom, fs, fe, CAST(fe - fs AS INTEGER) AS len, CAST((fs + fe) // 2 AS INTEGER) AS mid, CAST((fs + fe) // 2 + chrom * {FRAG_MULT} AS BIGINT) AS frag_id FROM frag1",
    "cf": _assigned("contacts"),
    "cf2": _assigned("contacts2"),
    "vp": f"SELECT * FROM cf WHERE {VALID}",
    "vp2": f"SELECT * FROM cf2 WHERE {VALID}",
    "sides": "SELECT rfrag1 AS rfrag, chrms1 = chrms2 AS cis FROM vp UNION ALL SELECT rfrag2, chrms1 = chrms2 FROM vp",
    "fc": "SELECT f.abs_idx, count(s.rfrag) AS n FROM frag f LEFT JOIN sides s ON s.rfrag = f.abs_idx GROUP BY f.abs_idx",
    "bins": f"SELECT CAST(b AS INTEGER) AS bin, CAST(b // {PER} AS INTEGER) AS chrom, CAST(b % {PER} AS INTEGER) AS pos_bin, (b % {PER}) * {RES} AS start, least((b % {PER} + 1) * {RES}, {LENGTH}) AS \"end\", "
    f"CAST(2 * (b // {PER}) + CASE WHEN (b % {PER}) * {RES} + {RES} / 2.0 > 950000 THEN 1 ELSE 0 END AS INTEGER) AS arm, ((b * 37 + 11) % 101) / 101.0 AS gc, CAST((b * 7919) % 100 * 1000 AS INTEGER) AS mapped_bases FROM range({NBINS}) t(b)",
    "px": _pixels("vp"),
    "px2": _pixels("vp2", "dataset, "),
    "pxc": f"SELECT *, bin1 // {PER} AS chrom1, bin2 // {PER} AS chrom2 FROM px",
    "px2c": f"SELECT *, bin1 // {PER} AS chrom1, bin2 // {PER} AS chrom2 FROM px2",
    "full_px": "SELECT bin1, bin2, value, chrom1, chrom2 FROM pxc UNION ALL SELECT bin2, bin1, value, chrom2, chrom1 FROM pxc WHERE bin1 <> bin2",
    "marg": "SELECT bin1 AS bin, CAST(sum(value) AS BIGINT) AS total FROM full_px GROUP BY bin1",
    "marg2": "SELECT dataset, bin, CAST(sum(value) AS BIGINT) AS total FROM (SELECT dataset, bin1 AS bin, value FROM px2 UNION ALL SELECT dataset, bin2, value FROM px2 WHERE bin1 <> bin2) GROUP BY ALL",
    "ooe0": "SELECT bin1, bin2, chrom1 AS chrom, bin2 - bin1 AS d, value FROM pxc WHERE chrom1 = chrom2",
    "ooem": f"SELECT chrom, d, sum(value) / ({PER}.0 - d) AS mean FROM ooe0 GROUP BY chrom, d",
    "ooe": "SELECT bin1, bin2, chrom, d, value / mean AS value FROM ooe0 JOIN ooem USING (chrom, d)",
    "loops": "SELECT CAST(p_partkey % 5 AS INTEGER) AS chrom, (p_partkey * 7919) % 1500000 AS start, (p_partkey * 7919) % 1500000 + (p_partkey * 131) % 500000 AS \"end\" FROM part",
    "domains": "SELECT CAST(p_partkey % 5 AS INTEGER) AS chrom, (p_partkey * 104729) % 1200000 AS start, (p_partkey * 104729) % 1200000 + 100000 + (p_partkey * 17) % 300000 AS \"end\" FROM part",
}
ORDER = list(CTES)


def with_tables(tail: str, more: dict[str, str] | None = None) -> str:
    """``tail`` behind a WITH clause that has what it names, and what those name."""
    tables = CTES | (more or {})
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in tables:
            if name not in needed and re.search(rf"(?<![\w.]){name}\b(?!\s*\()", text):
                needed.add(name)
                need(tables[name])

    need(tail)
    listed = [n for n in tables if n in needed]
    return ("WITH " + ",\n".join(f"{n} AS ({tables[n]})" for n in listed) + "\n" if listed else "") + tail

"""Column builders: text and sequence cleaning, statistics, distances, hash draws. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value", lower case.
BLANKS = ("", "na", "nan", "none", "unclassified")
#: Ranks from the deepest to the widest; what none supports is NO_CALL.
RANKS = ("species", "genus", "family", "order")
NO_CALL = "no_call"
EARTH_KM = 6371.0088


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def clean_taxon(c: Column | str) -> Column:
    """Trimmed text, null for null and for any text that stands for no value."""
    s = strip(c)
    return F.when(~F.lower(s).isin(*BLANKS), s)


def tree_label(species: Column | str) -> Column:
    """Label form of a name: quotes off, runs of white space as one underscore."""
    return F.regexp_replace(F.regexp_replace(clean_taxon(species), "['\"]", ""), r"\s+", "_")


def genus_of_label(label: Column | str) -> Column:
    return F.substring_index(col(label), "_", 1)


def first_value(*columns: Column | str) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[clean_taxon(c) for c in columns])


def record_key(c: Column | str) -> Column:
    """One spelling of a record's id: capitals, letters and digits only, without the marker after a full stop; null where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(col(c)), r"\..*$", ""), r"[^A-Z0-9]", "")
    return F.when(plain != "", plain)


# -- sequences -----------------------------------------------------------------------------------


def clean_sequence(c: Column | str) -> Column:
    """Upper case letters A, C, G, T and N only."""
    return F.regexp_replace(F.upper(col(c)), "[^ACGTN]", "")


def count_of(c: Column | str, letters: str) -> Column:
    """How many characters of a text are among `letters`."""
    return F.length(F.regexp_replace(col(c), f"[^{letters}]", ""))


def n_fraction(c: Column | str) -> Column:
    return F.when(F.length(col(c)) > 0, count_of(c, "N") / F.length(col(c)))


def pad_left(c: Column | str, width: int = 660) -> Column:
    """N on the left up to `width`; what is longer keeps its left part."""
    return F.lpad(col(c), width, "N")


def reverse_complement(c: Column | str) -> Column:
    return F.translate(F.reverse(col(c)), "ACGT", "TGCA")


def amplicon(seq: Column | str, forward: str, reverse: str) -> Column:
    """From the forward primer to the end of the reverse primer's complement, else to the reverse primer; null where a primer lacks."""
    s = col(seq)
    rc = reverse[::-1].translate(str.maketrans("ACGT", "TGCA"))
    f = F.locate(forward, s)
    after = f + len(forward)
    a, b = F.locate(rc, F.substr(s, after)), F.locate(reverse, F.substr(s, after))
    end = F.when(a > 0, after + a - 1 + len(rc)).when(b > 0, after + b - 1 + len(reverse))
    return F.when((f > 0) & end.isNotNull(), F.substr(s, f, end - f))


def kmers(seq: Column | str, k: int, distinct: bool = True) -> Column:
    """K-mers in order of place; those with N are left out. Shorter sequences have none."""
    s = col(seq)
    all_ = F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    clean = F.filter(all_, lambda x: ~x.contains("N"))
    return F.array_distinct(clean) if distinct else clean


def p_distance(a: Column | str, b: Column | str) -> Column:
    """Share of places that differ among those where both have a plain base; null where there is none."""
    pairs = F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: F.when(x.isin("A", "C", "G", "T") & y.isin("A", "C", "G", "T"), F.when(x != y, 1).otherwise(0)))
    seen = F.filter(pairs, lambda x: x.isNotNull())
    return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0), lambda acc, x: acc + x) / F.size(seen))


# -- vectors -------------------------------------------------------------------------------------


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


# -- statistics ----------------------------------------------------------------------------------


def wilson(k: Column | str, n: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson bounds of k out of n, within 0 and 1; null where n is 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p, z2 = k / n, z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def clipped_logit(p: Column | str) -> Column:
    """Log odds with the numerator kept within 1e-6 of the ends; null counts as 0."""
    p = F.coalesce(col(p).cast("double"), F.lit(0.0))
    up = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    down = F.least(F.greatest(1 - p, F.lit(1e-6)), F.lit(1.0))
    return F.ln(up / down)


def finite(c: Column | str) -> Column:
    """The value, null for NaN and the infinities."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def meets(value: Column | str, threshold: Column | str) -> Column:
    """Whether a finite value reaches a threshold; false where either lacks."""
    return F.coalesce(finite(value) >= col(threshold), F.lit(False))


def entropy_term(n: Column | str, total: Column | str) -> Column:
    p = col(n) / col(total)
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


# -- places and draws ----------------------------------------------------------------------------


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def hash_parity(value: Column | str) -> Column:
    """0 or 1 by the first eight hex digits of the value's sha1."""
    return (F.conv(F.substring(F.sha1(col(value)), 1, 8), 16, 10).cast("long") % 2).cast("int")


def hash_fraction(value: Column | str, salt: str) -> Column:
    """A number in [0, 1) by the first twelve hex digits of the sha1 of salt:value."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(salt + ":"), col(value))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def parse_list(c: Column | str) -> Column:
    """A list of texts from JSON or from a text parted by pipe, comma or semicolon; empty for blanks."""
    s = strip(c)
    parts = F.filter(F.transform(F.split(s, r"\s*[|,;]\s*"), lambda x: strip(x)), lambda x: x != "")
    return F.when(clean_taxon(c).isNull(), F.array().cast("array<string>")).when(s.startswith("["), F.from_json(s, "array<string>")).otherwise(parts)


def parse_scores(c: Column | str) -> Column:
    return F.transform(parse_list(c), lambda x: x.try_cast("double"))


def deepest(flags: dict[str, Column], otherwise: str = NO_CALL) -> Column:
    """Name of the first rank, from the deepest, whose flag holds."""
    out = F.lit(otherwise)
    for rank in reversed([r for r in RANKS if r in flags]):
        out = F.when(F.coalesce(flags[rank], F.lit(False)), F.lit(rank)).otherwise(out)
    return out


def method_parts(method: Column | str) -> dict[str, Column]:
    """Encoder, context and prior that a method's name tells of; longer names are tried before the shorter they hold."""
    m = F.lower(col(method))
    prior = F.when(m.contains("rls_obis"), "rls_obis").when(m.contains("rls"), "rls").when(m.contains("obis"), "obis").when(m.contains("cooc"), "cooc").otherwise("none")
    encoder = F.when(m.startswith("kmer"), "kmer").when(m.startswith("cnn"), "cnn").when(m.startswith("ssm"), "ssm").when(m.startswith("blast"), "blast").otherwise("other")
    context = F.when(m.contains("cooc"), "sample").when(prior != "none", "prior").otherwise("sequence")
    return {"encoder_kind": encoder, "prior_kind": prior, "context_kind": context}

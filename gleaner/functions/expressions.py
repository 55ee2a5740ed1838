"""Column expressions: signatures, distances, similarities, calibration and scoring scalars. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def total(values: Column) -> Column:
    """Sum of an array of doubles, 0 if empty."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    """Mean of an array's non-null values; null without any."""
    held = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, total(held) / F.size(held))


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


# Signatures


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64.0


def decode_fields(text: Column, fields: dict[str, str], *, whole: str | None = None) -> Column:
    """A struct of typed fields of a JSON object's text, by :func:`try_parse_json`; with ``whole``, all of it as that type too.

    Broken text, other values than objects, absent fields and values of another type give null, or the empty array or map.
    """
    own = F.try_parse_json(text)
    held = F.when(F.schema_of_variant(own).startswith("OBJECT"), own)

    def field(path: str, kind: str) -> Column:
        value = F.try_variant_get(held, path, kind)
        empty = F.array() if kind.startswith("array") else F.create_map() if kind.startswith("map") else None
        return value if empty is None else F.coalesce(value, empty.cast(kind))

    return F.struct(*(field(f"$.{name}", kind).alias(name) for name, kind in fields.items()), *([field("$", whole).alias("whole")] if whole else []))


def token_bits(token: Column) -> Column:
    """60 hash bits of a token, as a non-negative number."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint")


def bits_to_bigint(bits: Column) -> Column:
    """An array of up to 64 0/1, most significant first, as a number; the first of 64 is its sign."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def gradient_bits(cells: Column, width: int, rows: int) -> Column:
    """Difference signature: in each row, whether the next cell is brighter."""
    at = lambda i: F.get(cells, i.cast("int"))
    steps = F.sequence(F.lit(0), F.lit(rows * (width - 1) - 1))
    place = lambda i: F.floor(i / (width - 1)) * width + i % (width - 1)
    return F.transform(steps, lambda i: F.when(at(place(i) + 1) > at(place(i)), 1).otherwise(0).cast("bigint"))


def median_bits(values: Column) -> Column:
    """Median signature: whether each value lies above the median of all but the first."""
    rest = F.array_sort(F.slice(values, F.lit(2), F.size(values) - 1))
    n = F.size(rest)
    middle = (F.get(rest, F.floor((n - 1) / 2).cast("int")) + F.get(rest, F.floor(n / 2).cast("int"))) / 2.0
    return F.zip_with(values, F.array_repeat(middle, F.size(values)), lambda x, m: F.when(x > m, 1).otherwise(0).cast("bigint"))


def cosine_transform(cells: Column, size: int) -> Column:
    """The coefficients of a square grid of cells (row by row) in the orthonormal cosine basis, row by row.

    The transform is separable: first down the columns, then along the rows.
    """
    import math

    basis = [[math.sqrt((1 if k == 0 else 2) / size) * math.cos((2 * i + 1) * k * math.pi / (2 * size)) for i in range(size)] for k in range(size)]
    table = F.array(*(F.array(*(F.lit(x) for x in row)) for row in basis))
    along = F.sequence(F.lit(0), F.lit(size - 1))
    cell = lambda c, k: F.get(c, k).cast("double")
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    half = F.transform(table, lambda row: F.transform(along, lambda x: total(F.zip_with(row, along, lambda f, y: f * cell(cells, y * size + x)))))
    return F.flatten(F.transform(half, lambda line: F.transform(table, lambda row: total(F.zip_with(row, line, lambda f, v: f * v)))))


def cosine_bits(cells: Column, size: int) -> Column:
    """Cosine signature: whether each coefficient lies above the median of all but the constant one."""
    return median_bits(cosine_transform(cells, size))


def band_keys(signature: Column, widths: tuple[int, ...]) -> Column:
    """Array of (band, value): the signature's slices, from its lowest bits."""
    out, at = [], 0
    for k, w in enumerate(widths):
        out.append(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(signature, at).bitwiseAND(F.lit((1 << w) - 1)).alias("value")))
        at += w
    return F.array(*out)


def near_values(value: Column, width: Column) -> Column:
    """A band's value and all values one bit from it."""
    flipped = F.transform(F.sequence(F.lit(0), width - 1), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    return F.concat(F.array(value), flipped)


# Vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; null for other sizes, near-zero or non-finite vectors."""
    scale = norm(a) * norm(b)
    fine = (F.size(a) == F.size(b)) & (norm(a) > 1e-8) & (norm(b) > 1e-8) & ~F.isnan(scale) & (scale < F.lit(float("inf")))
    return F.when(fine, clamp(dot(a, b) / scale, -1.0, 1.0))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Cosine of two histograms; 0 where one is empty."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def mean_abs_error(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.size(a)


def standardized(values: Column, floor: float = 0.05, clip: float = 4.0) -> Column:
    """z-scores with a least deviation, clipped."""
    own = F.transform(values, lambda x: x.cast("double"))
    middle = total(own) / F.size(own)
    spread = F.sqrt(F.greatest(total(F.transform(own, lambda x: x * x)) / F.size(own) - middle * middle, F.lit(0.0)))
    return F.zip_with(own, F.array_repeat(F.struct(middle.alias("m"), F.greatest(spread, F.lit(floor)).alias("s")), F.size(own)), lambda x, p: clamp((x - p["m"]) / p["s"], -clip, clip))


def exposure_invariant_error(a: Column, b: Column) -> Column:
    """Mean absolute error of z-scores over 4, at most 1: brightness and contrast don't count."""
    return F.least(mean_abs_error(standardized(a), standardized(b)) / 4.0, F.lit(1.0))


# Space and time


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null for coordinates out of range."""
    fine = F.abs(lat1).__le__(90) & F.abs(lat2).__le__(90) & F.abs(lon1).__le__(180) & F.abs(lon2).__le__(180)
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    h = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return F.when(fine, 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def location_change(km: Column, seconds: Column) -> Column:
    """At least 2 km apart, and with unknown time, 25 km or 120 s between."""
    return F.coalesce((km >= 2) & (seconds.isNull() | (km >= 25) | (seconds >= 120)), F.lit(False))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def time_delta_seconds(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6


def aspect_delta(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Difference of two aspect ratios over the larger; missing sides count as 1."""
    ratio = lambda w, h: F.coalesce(w, F.lit(1)).cast("double") / F.greatest(F.coalesce(h, F.lit(1)), F.lit(1))
    return F.abs(ratio(w1, h1) - ratio(w2, h2)) / F.greatest(ratio(w1, h1), ratio(w2, h2), F.lit(0.001))


# Calibration and scores


def logit(p: Column) -> Column:
    q = clamp(p, 0.001, 0.999)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -20.0, 20.0)))


def apply_platt(p: Column, intercept: float | None, slope: float | None) -> Column:
    """The calibrated probability; the raw one without a model."""
    return p if intercept is None or slope is None else sigmoid(F.lit(intercept) + F.lit(slope) * logit(p))


def scale_affine(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """``low..high`` to 0..100, rounded half to even."""
    return F.bround(clamp((x - low) / (high - low), 0.0, 1.0) * 100, 0)


def series_score(in_series: Column, leader: Column, confidence: Column, margin: Column) -> Column:
    return F.when(~in_series, F.lit(70.0)).when(leader, F.lit(100.0)).otherwise(clamp(65 - 25 * confidence - 100 * margin, 0.0, 100.0))


def weighted_mean(pairs: list[tuple[Column, float]], empty: float | None = 0.0) -> Column:
    """Weighted mean of the available inputs, by their own weights; ``empty`` without any."""
    up = sum((F.when(x.isNotNull(), x * w).otherwise(0.0) for x, w in pairs), F.lit(0.0))
    down = sum((F.when(x.isNotNull(), F.lit(float(w))).otherwise(0.0) for x, w in pairs), F.lit(0.0))
    return F.when(down > 0, up / down).otherwise(F.lit(empty))


def disagreement(values: list[Column]) -> Column:
    """Mean distance from the median over 50, at most 1; null with fewer than two inputs."""
    held = F.array_sort(F.filter(F.array(*values), lambda x: x.isNotNull()))
    n = F.size(held)
    middle = (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2.0
    away = F.zip_with(held, F.array_repeat(middle, n), lambda x, m: F.abs(x - m))
    return F.when(n >= 2, F.least(total(away) / n / 50, F.lit(1.0)))


def component_mean(scores: Column, keys: list[str]) -> Column:
    """Mean of a map's values under some keys, times 100; null if none is there."""
    return mean(F.transform(F.array(*map(F.lit, keys)), lambda k: F.element_at(scores, k).cast("double"))) * 100


def node_id(kind: str, ids: Column) -> Column:
    """kind-, then 16 digits of the digest of the ids in order."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.array_join(ids, "|").cast("binary"), 256), 1, 16))


def pseudonym(*parts: Column) -> Column:
    """Digest of the parts, joined by a separator that ids don't hold."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def pair_rules(p: dict[str, Column]) -> list[tuple[str, Column]]:
    """The rules that make a candidate pair a duplicate, each true or false: equal content, strict, relaxed, burst and
    semantic evidence.

    ``p`` holds same_hash, phash, dhash (distances), aspect, hist, mae, xmae, dt, cos, burst. Unknown evidence (null)
    fails a rule, but for ``mae``, which only counts where it is known.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    mae = lambda top: p["mae"].isNull() | (p["mae"] <= top)
    strict = (p["phash"] <= 4) & (p["aspect"] <= 0.08) & (p["dhash"] <= 12) & (p["hist"] >= 0.72) & mae(0.18) & (p["dt"] <= 120)
    relaxed = (p["phash"] <= 10) & (p["dt"] <= 120) & (p["aspect"] <= 0.08) & (p["hist"] >= 0.84) & (p["dhash"] <= 18) & mae(0.22)
    burst = p["burst"] & (p["dhash"] <= 24) & (p["hist"] >= 0.60)
    semantic = (p["cos"] >= 0.985) & (p["dt"] <= 15) & (known(p["xmae"] <= 0.20) | known((p["hist"] >= 0.78) & (p["dhash"] <= 28)))
    return [(name, known(c)) for name, c in (("exact", p["same_hash"]), ("strict", strict), ("relaxed", relaxed), ("burst", burst), ("semantic", semantic))]


def confirm_pair(p: dict[str, Column]) -> Column:
    """Whether a candidate pair is a duplicate by any of the ``pair_rules``."""
    out = F.lit(False)
    for _, rule in pair_rules(p):
        out = out | rule
    return out


def pair_confidence(p: dict[str, Column]) -> Column:
    """How sure a confirmed pair is: 1 for equal content, else the better of its signature and its vectors, .75 at least;
    null for a pair that isn't confirmed."""
    near = F.greatest(F.lit(0.75), 1 - F.coalesce(p["phash"], F.lit(16)) / 16.0, F.least(F.lit(0.99), F.coalesce(p["cos"], F.lit(0.0))))
    return F.when(confirm_pair(p), F.when(F.coalesce(p["same_hash"], F.lit(False)), F.lit(1.0)).otherwise(near))


def explain_pair(p: dict[str, Column]) -> Column:
    """Generator: one row for each of the ``pair_rules`` that a pair satisfies."""
    return F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in pair_rules(p)])))


def comparable_moment(p: dict[str, Column], threshold: float) -> Column:
    """Whether two items show one moment: equal content, or alike in shape, similarity and signatures."""
    known = lambda c: F.coalesce(c, F.lit(False))
    close = ((p["phash"] <= 18) & (p["dhash"] <= 28) & (p["hist"] >= 0.72)) | (p["burst"] & (p["phash"] <= 24) & (p["hist"] >= 0.60))
    hashed = (p["aspect"] <= 0.12) & (p["sim"] >= max(0.90, threshold + 0.04)) & close
    return known(p["same_hash"]) | F.when(p["phash"].isNull(), known(p["burst"] & (p["sim"] >= 0.94))).otherwise(known(hashed))


def visual_semantic_similarity(cos: Column, phash: Column, hist: Column) -> Column:
    """Cosine where both vectors are known, else signatures and histograms, else null."""
    return F.coalesce(cos, 0.65 * (1 - phash / 64.0) + 0.35 * hist)


def marginal_novelty(vector: Column, chosen: Column, same_stack: Column) -> Column:
    """1 beside nothing chosen, else 1 less the largest cosine, not below 0; without vectors .15 in a stack already
    chosen from, .65 in another."""
    near = F.filter(F.transform(chosen, lambda x: cosine(vector, x)), lambda x: x.isNotNull())
    blind = F.when(F.coalesce(same_stack, F.lit(False)), F.lit(0.15)).otherwise(F.lit(0.65))
    return F.when(F.size(chosen) == 0, F.lit(1.0)).when(F.size(near) > 0, F.greatest(F.lit(0.0), 1 - F.array_max(near))).otherwise(blind)


def ranker_reliability(e: dict[str, Column]) -> Column:
    """Trust in a ranker, 0..1: the weaker of its sample's and its evaluation's strength, times its skill.

    ``e`` holds held_pairs, held_accuracy, held_items, held_contexts, own_pairs, own_accuracy, own_items, own_contexts.
    From three held-out pairs on those count; before that the accuracy on the training pairs, at half trust at most.
    """
    n = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    held = (n(e["held_pairs"]) >= 3) & e["held_accuracy"].isNotNull()
    accuracy = F.when(held, e["held_accuracy"]).otherwise(e["own_accuracy"])
    shown = F.when(held, F.least(F.lit(1.0), n(e["held_items"]) / 24, n(e["held_contexts"]) / 3)).otherwise(F.least(F.lit(0.5), n(e["own_pairs"]) / 60))
    sample = F.least(F.lit(1.0), n(e["own_items"]) / 24, n(e["own_contexts"]) / 3)
    return F.coalesce(F.round(F.least(sample, shown) * clamp((accuracy - 0.5) / 0.5, 0.0, 1.0), 3), F.lit(0.0))

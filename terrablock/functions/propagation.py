"""Radio propagation as column expressions: distances in metres, frequencies in MHz, losses in dB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL_LOSS, SENTINEL_RSSI, VALID_BELOW = 300.0, -110.0, 299.0


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def km(distance_m: Column) -> Column:
    return F.greatest(distance_m / 1000.0, F.lit(0.001))


def fspl(distance_m: Column, freq: Column) -> Column:
    return 20 * F.log10(km(distance_m)) + 20 * F.log10(freq) + 32.44


def _slope(h_tx: Column, distance_m: Column) -> Column:
    return (44.9 - 6.55 * F.log10(h_tx)) * F.log10(km(distance_m))


def _small_city(freq: Column, h_rx: Column) -> Column:
    return (1.1 * F.log10(freq) - 0.7) * h_rx - (1.56 * F.log10(freq) - 0.8)


def _suburban(urban: Column, freq: Column) -> Column:
    return urban - 2 * F.pow(F.log10(freq / 28), 2.0) - 5.4


def _rural(urban: Column, freq: Column) -> Column:
    return urban - 4.78 * F.pow(F.log10(freq), 2.0) + 18.33 * F.log10(freq) - 40.94


def hata_urban(distance_m: Column, freq: Column, h_tx: Column, h_rx: Column) -> Column:
    """Hata, large city: the receiver correction changes at 300 MHz."""
    low, high = 8.29 * F.pow(F.log10(1.54 * h_rx), 2.0) - 1.1, 3.2 * F.pow(F.log10(11.75 * h_rx), 2.0) - 4.97
    return 69.55 + 26.16 * F.log10(freq) - 13.82 * F.log10(h_tx) - F.when(freq <= 300, low).otherwise(high) + _slope(h_tx, distance_m)


def hata_suburban(distance_m: Column, freq: Column, h_tx: Column, h_rx: Column) -> Column:
    return _suburban(hata_urban(distance_m, freq, h_tx, h_rx), freq)


def hata_rural(distance_m: Column, freq: Column, h_tx: Column, h_rx: Column) -> Column:
    return _rural(hata_urban(distance_m, freq, h_tx, h_rx), freq)


def _cost231(distance_m: Column, freq: Column, h_tx: Column, h_rx: Column, extra: Column) -> Column:
    return 46.3 + 33.9 * F.log10(freq) - 13.82 * F.log10(h_tx) - _small_city(freq, h_rx) + _slope(h_tx, distance_m) + extra


def cost231_urban(distance_m: Column, freq: Column, h_tx: Column, h_rx: Column) -> Column:
    return _cost231(distance_m, freq, h_tx, h_rx, F.lit(3.0))


def cost231_suburban(distance_m: Column, freq: Column, h_tx: Column, h_rx: Column) -> Column:
    return _cost231(distance_m, freq, h_tx, h_rx, F.lit(0.0))


def log_distance(distance_m: Column, freq: Column, n: float = 3.5, d0: float = 1.0, shift: float = 0.0) -> Column:
    return fspl(F.lit(d0), freq) + 10 * n * F.log10(F.greatest(distance_m, F.lit(d0)) / d0) + shift


#: Models by name: distance, frequency, transmitter height, receiver height to path loss.
MODELS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "fspl": lambda d, f, t, r: fspl(d, f),
    "hata_urban": hata_urban,
    "hata_suburban": hata_suburban,
    "hata_rural": hata_rural,
    "cost231_urban": cost231_urban,
    "cost231_suburban": cost231_suburban,
    "log_distance": lambda d, f, t, r: log_distance(d, f),
}


def predict(model: str, distance_m: Column, freq: Column, h_tx: Column, h_rx: Column, power_dbm: Column) -> dict[str, Column]:
    """Path loss, received level and coverage (level above -100 dBm) under a model of MODELS."""
    loss = MODELS[model](distance_m, freq, h_tx, h_rx)
    return {"loss": loss, "rssi": power_dbm - loss, "covered": power_dbm - loss > -100}


def terrain_term(slope: Column) -> Column:
    return clip(slope * 20.0 + F.when(slope > 0.1, (slope - 0.1) * 30.0).otherwise(0.0), 0, 30)


def combined_loss(distance_m: Column, freq: Column, h_tx: Column, h_rx: Column, ndvi: Column, slope: Column, environment: str = "suburban") -> Column:
    """Hata up to 1500 MHz, COST-231 above (both small-city, frequency clipped to their range), plus vegetation and terrain."""
    f = clip(freq, 150, 2000)
    urban = 69.55 + 26.16 * F.log10(f) - 13.82 * F.log10(h_tx) - _small_city(f, h_rx) + _slope(h_tx, distance_m)
    hata = {"urban": urban, "suburban": _suburban(urban, f)}.get(environment, _rural(urban, f))
    cost = _cost231(distance_m, clip(freq, 1500, 2000), h_tx, h_rx, F.lit(3.0 if environment == "urban" else 0.0))
    depth = F.least(distance_m * clip((ndvi + 1) / 2, 0, 1) * 0.3, F.lit(400.0))
    vegetation = clip(0.25 * F.pow(freq, F.lit(0.39)) * F.pow(depth, F.lit(0.25)), 0, 40)
    return F.when(freq <= 1500, hata).otherwise(cost) + vegetation + terrain_term(slope)


def terrain_corrected(loss: Column, rssi: Column, old_slope: Column, new_slope: Column) -> tuple[Column, Column]:
    """Loss and level after the terrain term of old_slope gives way to that of new_slope; sentinels stay."""
    delta = terrain_term(new_slope) - terrain_term(old_slope)
    valid = loss != SENTINEL_LOSS
    return F.when(valid, loss + delta).otherwise(loss), F.when(valid, rssi - delta).otherwise(rssi)


def shadow_margin(ndvi: Column, distance_m: Column, freq: Column) -> Column:
    depth = distance_m * clip(ndvi - 0.5, 0, 1)
    return clip(depth * 0.2 * clip(ndvi, 0, 1) * F.pow(freq / 1000.0 / 1.8, F.lit(0.4)), 0, 40)


def knife_edge(v: Column) -> Column:
    """Lee's five-piece approximation of the loss over one edge; 0 below -0.7."""

    def loss(x: Column) -> Column:
        return -20.0 * F.log10(F.greatest(x, F.lit(1e-9)))

    curved = 0.4 - F.sqrt(F.greatest(0.1184 - F.pow(0.38 - 0.1 * v, 2.0), F.lit(1e-9)))
    pieces = F.when(v < -0.7, 0.0).when(v <= 0, loss(0.5 - 0.62 * v)).when(v <= 1, loss(0.5 * F.exp(-0.95 * v))).when(v <= 2.4, loss(curved)).otherwise(loss(0.225 / v))
    return F.greatest(pieces, F.lit(0.0))


def diffraction_loss(tri_m: Column, roughness: Column, distance_m: Column, freq: Column) -> Column:
    """One edge at mid-path, its height a proxy from ruggedness and roughness; at most 40 dB."""
    height = clip(F.greatest(tri_m, F.lit(0.0)) * 0.5 + roughness * 0.5, 0, 80)
    half = F.greatest(distance_m / 2.0, F.lit(1.0))
    wave = 3e8 / (freq * 1e6)
    return F.least(knife_edge(height * F.sqrt(2.0 * (half + half) / (wave * half * half + 1e-9))), F.lit(40.0))


def watts_to_dbm(watts: Column) -> Column:
    return F.when(watts > 0, 10 * F.log10(1000 * watts)).otherwise(30.0)


def environment_of(freq: Column) -> Column:
    return F.when(freq > 1800, "urban").when(freq > 800, "suburban").otherwise("rural")


def coverage_class(rssi: Column) -> Column:
    """1 (from -70 dBm on) to 5 (below -110 dBm)."""
    return F.when(rssi >= -70, 1).when(rssi >= -85, 2).when(rssi >= -100, 3).when(rssi >= -110, 4).otherwise(5)


#: Output channels with their scale, offset and limits (loss in all, by vegetation, by terrain; level; coverage).
CHANNELS = {"loss": (100.0, 100.0, 0.0, 200.0), "vegetation": (25.0, 25.0, 0.0, 50.0), "terrain": (15.0, 15.0, 0.0, 30.0), "rssi": (75.0, -75.0, -150.0, 0.0), "coverage": (None, None, 0.0, 1.0)}


def decoded(raw: Column, channel: str) -> Column:
    """An output in its unit: scaled and shifted, or through a sigmoid for coverage."""
    scale, shift, _, _ = CHANNELS[channel]
    return raw * scale + shift if scale else 1 / (1 + F.exp(-raw))


def clamped(value: Column, channel: str) -> Column:
    return clip(value, *CHANNELS[channel][2:])


#: Operators with an id of their own; any other is the last.
OPERATORS = {"CLARO": 0, "TIM": 1, "VIVO": 2, "OUTROS": 3}


def operator_id(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in OPERATORS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(name))), F.lit(OPERATORS["OUTROS"]))


def canopy_loss(height_m: Column, freq: Column) -> Column:
    """Vegetation loss of a canopy up to 30 m high: 0.2 f^0.3 h, f in GHz."""
    return 0.2 * F.pow(freq / 1000.0, F.lit(0.3)) * clip(height_m, 0, 30)


def huber(error: Column, delta: float = 5.0) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))

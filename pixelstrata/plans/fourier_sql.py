"""Direct Fourier sums of 8 x 8 images in SQL, zero frequency at (4, 4)."""

DFT = """
    {name}f AS (SELECT {k}, frame, (v.range + 4) % 8 AS v, (u.range + 4) % 8 AS u,
        pow(sum({r} * cos(2 * pi() * (v.range * y + u.range * x) / 8)), 2) + pow(sum({r} * sin(2 * pi() * (v.range * y + u.range * x) / 8)), 2) AS p
      FROM {src}, range(8) v, range(8) u GROUP BY ALL),
    {name} AS (SELECT {k}, v, u, avg(p) AS p FROM {name}f GROUP BY ALL)"""

RAD = "CAST(floor(sqrt((v - 4) * (v - 4) + (u - 4) * (u - 4))) AS BIGINT)"
FREQ = "sqrt((v - 4) * (v - 4) + (u - 4) * (u - 4)) / 8"
EDGES = (0.126, 0.26, 0.4)
HANN = "(0.5 - 0.5 * cos(2 * pi() * y / 7)) * (0.5 - 0.5 * cos(2 * pi() * x / 7))"
BANDS_SQL = (f"R8(sum(CASE WHEN f = 0 THEN p ELSE 0 END) / sum(p)) AS dc_fraction, R8(sum(CASE WHEN f > 0 AND f < {EDGES[0]} THEN p ELSE 0 END) / sum(p)) AS very_low_fraction, "
             f"R8(sum(CASE WHEN f >= {EDGES[0]} AND f < {EDGES[1]} THEN p ELSE 0 END) / sum(p)) AS low_fraction, "
             f"R8(sum(CASE WHEN f >= {EDGES[1]} AND f < {EDGES[2]} THEN p ELSE 0 END) / sum(p)) AS mid_fraction, R8(sum(CASE WHEN f >= {EDGES[2]} THEN p ELSE 0 END) / sum(p)) AS high_fraction")

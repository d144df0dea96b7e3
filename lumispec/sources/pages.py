"""Interactive pages: spectra of some samples as one HTML file with zoom by dragging, no outside script."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..operators.spectra import SAMPLE, tidy, to_arrays

#: Points that one page may hold.
POINTS = 5_000_000

PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><canvas id="c" width="1200" height="600"></canvas><script>
const lines = {data}, c = document.getElementById("c"), g = c.getContext("2d");
const xs = lines.flatMap(l => [Math.min(...l.x), Math.max(...l.x)]); let lo = Math.min(...xs), hi = Math.max(...xs), from = null;
function draw() {{
  g.clearRect(0, 0, c.width, c.height); let top = -Infinity, low = Infinity;
  for (const l of lines) l.x.forEach((x, i) => {{ if (x >= lo && x <= hi) {{ top = Math.max(top, l.y[i]); low = Math.min(low, l.y[i]); }} }});
  lines.forEach((l, k) => {{ g.strokeStyle = `hsl(${{k * 137 % 360}} 70% 40%)`; g.beginPath(); l.x.forEach((x, i) => {{ if (x >= lo && x <= hi)
    g.lineTo((hi - x) / (hi - lo) * c.width, c.height - (l.y[i] - low) / (top - low || 1) * c.height); }}); g.stroke(); }});
}}
c.onmousedown = e => from = e.offsetX; c.ondblclick = () => {{ lo = Math.min(...xs); hi = Math.max(...xs); draw(); }};
c.onmouseup = e => {{ if (from === null || e.offsetX === from) return; const at = p => hi - p / c.width * (hi - lo); [lo, hi] = [at(Math.max(from, e.offsetX)), at(Math.min(from, e.offsetX))]; from = null; draw(); }};
draw();
</script>"""


def page(spectra: DataFrame, samples: list, title: str = "spectra", ppm_range: tuple[float, float] | None = None, every: int = 1) -> str:
    """The page of the named samples; more than POINTS points are an error, not a cut."""
    chosen = tidy(spectra.where(spectra[SAMPLE].isin(samples)), None, ppm_range, every)
    n = chosen.count()
    if n > POINTS:
        raise ValueError(f"{n} points are too many for a page; take fewer samples, a range, or every k-th point")
    rows = sorted(to_arrays(chosen).collect(), key=lambda r: str(r[SAMPLE]))
    data = json.dumps([{"id": str(r[SAMPLE]), "x": r["ppm"], "y": r["intensity"]} for r in rows]).replace("</", "<\\/")
    return PAGE.format(title=title.replace("<", "&lt;"), data=data)

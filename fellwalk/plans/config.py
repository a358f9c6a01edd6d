"""Settings of a bake, read from environment-like strings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    target_res_m: float = 5.0
    grid_min: int = 700
    grid_max: int = 3000
    bbox_margin_deg: float = 0.0025
    edge_pad_cells: int = 8
    dem_res_m: float = 1.0
    tile_zoom: int = 17
    texture_max_px: int = 8192
    saturation: float = 1.45
    brightness: float = 0.82
    contrast: float = 1.16
    route_step_m: float = 2.0
    mesh_sigma: float = 0.0
    relief_sigma: float = 0.1
    slope_sigma: float = 0.6
    contour_minor_m: float = 40.0
    contour_major_m: float = 200.0
    contours: bool = False
    forest_px: int = 2048
    forest_min_cover: float = 50.0
    smooth_horizontal: int = 15
    smooth_vertical: int = 61
    gain_threshold_m: float = 3.0

    def __post_init__(self):
        wrong = [
            name
            for name, ok in (
                ("target_res_m", self.target_res_m > 0),
                ("grid_min", 2 <= self.grid_min <= self.grid_max),
                ("bbox_margin_deg", self.bbox_margin_deg >= 0),
                ("edge_pad_cells", self.edge_pad_cells >= 0),
                ("dem_res_m", self.dem_res_m > 0),
                ("tile_zoom", 0 <= self.tile_zoom <= 22),
                ("texture_max_px", self.texture_max_px > 0),
                ("route_step_m", self.route_step_m > 0),
                ("sigma", min(self.mesh_sigma, self.relief_sigma, self.slope_sigma) >= 0),
                ("contour_minor_m", self.contour_minor_m > 0),
                ("contour_major_m", self.contour_major_m > 0),
                ("forest_min_cover", 0 <= self.forest_min_cover < 100),
            )
            if not ok
        ]
        if wrong:
            raise ValueError(f"out of range: {', '.join(wrong)}")

    @classmethod
    def of(cls, env: Mapping[str, str], prefix: str = "BAKE_") -> Config:
        """Fields from variables such as BAKE_GRID_MAX; blank ones keep their defaults."""
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper(), "").strip()
            if not raw:
                continue
            if f.type == "bool":
                if raw.lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
                    raise ValueError(f"{f.name}: {raw!r} is no truth value")
                found[f.name] = raw.lower() in ("1", "true", "yes", "on")
            else:
                found[f.name] = (int if f.type == "int" else float)(raw)
        return cls(**found)

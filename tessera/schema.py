"""Schemas of tiles, layers, features and geometries."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
GEOM = f"struct<kind:string,parts:array<array<array<{POINT}>>>>"
VALUE = "struct<tag:tinyint,s:string,f:float,d:double,i:bigint,u:bigint,b:boolean>"
TILE = "z int, x bigint, y bigint, data binary"
FEATURE = f"layer_idx int, layer string, version int, extent int, fid bigint, gtype tinyint, geom {GEOM}, attrs map<string,{VALUE}>, raster binary, corrupt string"
HEADER = "layer_idx int, layer string, version int, extent int, n_features bigint, n_keys bigint, n_values bigint, keys array<string>, has_raster boolean, corrupt string"
EMPTY, POINTS, LINES, POLYGONS = 0, 1, 2, 3
#: Members of a value message by tag.
STRING, FLOAT, DOUBLE, INT, UINT, SINT, BOOL = 1, 2, 3, 4, 5, 6, 7

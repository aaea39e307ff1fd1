"""Schemas and codes of mesh tables."""

VERTEX, EDGE, FACE, REGION, ANY = 0, 1, 2, 3, 5
INTERIOR, OVERLAP, BOUNDARY, GHOST = 0, 1, 2, 3
#: Classification of an entity that has none.
UNKNOWN_DIM, UNKNOWN_ID = 4, 0
KIND = {VERTEX: ("V", "vid"), EDGE: ("E", "eid"), FACE: ("F", "fid"), REGION: ("R", "rid")}

SCHEMAS = {
    "V": "vid long, x double, y double, z double, gdim int, gent long",
    "E": "eid long, v0 long, v1 long, lo long, hi long, gdim int, gent long",
    "F": "fid long, n int, gdim int, gent long",
    "FE": "fid long, pos int, eid long, dir int",
    "FV": "fid long, pos int, vid long",
    "R": "rid long, rtype string, gdim int, gent long",
    "RF": "rid long, pos int, fid long, dir int",
    "RV": "rid long, pos int, vid long",
    "AD": "name string, atype string, ncomp int, entdim int",
    "AV": "name string, dim int, id long, ival int, dval double, vval array<double>, ref struct<dim:int,id:long>",
    "SD": "set string, entdim int",
    "SM": "set string, pos int, dim int, id long",
    "G": "dim int, id long, gid long",
}

#: Faces of standard cells as places in their vertex lists (outward loops, bottom loop first, then the top).
#: The order of loops is part of the native format.
TEMPLATES = {
    "TET": [[0, 2, 1], [0, 1, 3], [1, 2, 3], [0, 3, 2]],
    "PYRAMID": [[0, 3, 2, 1], [0, 1, 4], [1, 2, 4], [2, 3, 4], [3, 0, 4]],
    "PRISM": [[0, 2, 1], [3, 4, 5], [0, 1, 4, 3], [1, 2, 5, 4], [2, 0, 3, 5]],
    "HEX": [[0, 3, 2, 1], [4, 5, 6, 7], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7]],
}

"""Chunks of space by Morton codes, and node ids that carry their layer and chunk.

Layer 1 are supervoxels, layer 2 lies in the smallest chunks, and a chunk of each further layer is eight of the one below.
A chunk's Morton code interleaves the bits of its three coordinates, so that the code of the chunk around it, one layer
higher, is the code without its last three bits: ancestors are prefixes. From high to low, an id holds the layer (8 bits),
the chunk's code in that layer and a number within the chunk (SEGMENT_BITS).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each coordinate of a chunk of layer 2, and of the number within a chunk.
AXIS_BITS, SEGMENT_BITS = 10, 25
#: The layer that stands for the root, whichever it is.
ROOT_LAYER = 127

#: Shifts and masks that leave two zeros behind each of the low ten bits of a number.
_SPREAD = ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249))


def _spread(c: Column) -> Column:
    out = c.cast("long").bitwiseAND(F.lit((1 << AXIS_BITS) - 1))
    for shift, mask in _SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return out


def morton(x: Column, y: Column, z: Column) -> Column:
    """The code of a chunk's coordinates, of which the low AXIS_BITS bits count; x has the lowest bit. Null if one is null."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def chunk_at(code: Column, layer: int) -> Column:
    """The code of the chunk of a layer that holds the chunk of layer 2 (or 1) with this code."""
    return F.shiftright(code, 3 * max(layer - 2, 0))


def node_id(layer, chunk: Column, number: Column) -> Column:
    """The id of a node: layer (a column or a number), its chunk's code in that layer, and its number there."""
    layer = F.lit(layer) if isinstance(layer, int) else layer
    return F.shiftleft(layer.cast("long"), 3 * AXIS_BITS + SEGMENT_BITS).bitwiseOR(F.shiftleft(chunk.cast("long"), SEGMENT_BITS)).bitwiseOR(number.cast("long"))


def layer_of(node: Column) -> Column:
    return F.shiftright(node, 3 * AXIS_BITS + SEGMENT_BITS).cast("int")


def chunk_of(node: Column) -> Column:
    """The code of a node's chunk in the node's own layer."""
    return F.shiftright(node, SEGMENT_BITS).bitwiseAND(F.lit((1 << 3 * AXIS_BITS) - 1).cast("long"))

"""Connected components of a link table: the library's routine, by hooking, pointer jumping
and contraction, on the fingerprints that SimHash links."""

from ..operators.components import connected_components

__all__ = ["connected_components"]

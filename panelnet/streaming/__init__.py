"""An extension: the panel's monthly sums over an unbounded table of facts."""

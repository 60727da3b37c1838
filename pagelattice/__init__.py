"""PageLattice: page-layout analysis and reconstruction-quality scoring on PySpark."""

"""Column functions: genotypes, alleles, and the few statistics that need Python."""

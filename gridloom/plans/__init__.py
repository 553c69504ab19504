"""Plans that several operators share: ordered numbering, prefix carries, folds by bucket, index grids."""

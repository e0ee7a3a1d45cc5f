"""Query texts and specifications, and the plans that they become."""

"""End-to-end runs composed of the operators; everything stays lazy until a table is used."""

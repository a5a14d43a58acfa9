"""The dialect: parsing, lowering to DataFrames, and the registered queries."""

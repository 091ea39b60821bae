"""The cleaned tables, the star schema and the whole load, put together from the operators."""

"""Column expressions: parsing, money, tariff, statistics and text formats. All stay inside Catalyst."""

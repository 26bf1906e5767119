"""Column functions: text, places, prices, dates and attributes of listings and licences."""

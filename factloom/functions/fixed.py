"""Words, symbols and factors that results depend on. They are given as they are, without logic.

Factors are exact by definition (an inch is 0.0254 m, a pound 0.45359237 kg); data sizes follow SI and IEC.
"""

# Suffixes of day numbers.
DAY_SUFFIXES = "st nd rd th".split()

# Scale words apply to any number, abbreviations to money only (powers of ten).
SCALE_WORDS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
SCALE_ABBREVIATIONS = {"k": 3, "m": 6, "mn": 6, "bn": 9, "tn": 12}

# Currency signs; a sign that several currencies share stays as written. Longer signs come first.
CURRENCY_SIGNS = {
    "US$": "USD", "A$": "AUD", "CA$": "CAD", "NZ$": "NZD", "HK$": "HKD", "S$": "SGD", "€": "EUR", "£": "GBP", "₹": "INR",
    "Rs.": "Rs", "Rs": "Rs", "$": "$", "¥": "¥",
}

# ISO 4217 codes that are read.
CURRENCY_CODES = "USD EUR GBP JPY INR CNY CHF CAD AUD NZD SGD HKD SEK NOK DKK ZAR BRL MXN KRW".split()

# Canonical unit, factor to it, symbols (exact case), words (any case), apart by commas.
UNITS = [
    ("m", "0.001", "mm", "millimetre, millimetres, millimeter, millimeters"),
    ("m", "0.01", "cm", "centimetre, centimetres, centimeter, centimeters"),
    ("m", "1", "m", "metre, metres, meter, meters"),
    ("m", "1000", "km", "kilometre, kilometres, kilometer, kilometers"),
    ("m", "0.0254", "in", "inch, inches"),
    ("m", "0.3048", "ft", "foot, feet"),
    ("m", "1609.344", "mi", "mile, miles"),
    ("kg", "0.000001", "mg", "milligram, milligrams, milligramme, milligrammes"),
    ("kg", "0.001", "g", "gram, grams, gramme, grammes"),
    ("kg", "1", "kg", "kilogram, kilograms, kilogramme, kilogrammes"),
    ("kg", "1000", "t", "tonne, tonnes"),
    ("kg", "0.45359237", "lb, lbs", ""),
    ("kg", "0.028349523125", "oz", "ounce, ounces"),
    ("s", "0.001", "ms", "millisecond, milliseconds"),
    ("s", "1", "s, sec, secs", "second, seconds"),
    ("s", "60", "min, mins", "minute, minutes"),
    ("s", "3600", "h, hr, hrs", "hour, hours"),
    ("s", "86400", "", "day, days"),
    ("s", "604800", "wk, wks", "week, weeks"),
    ("year", "1", "yr, yrs", "year, years"),
    ("B", "1", "B", "byte, bytes"),
    ("B", "1000", "kB, KB", "kilobyte, kilobytes"),
    ("B", "1000000", "MB", "megabyte, megabytes"),
    ("B", "1000000000", "GB", "gigabyte, gigabytes"),
    ("B", "1000000000000", "TB", "terabyte, terabytes"),
    ("B", "1000000000000000", "PB", "petabyte, petabytes"),
    ("B", "1024", "KiB", "kibibyte, kibibytes"),
    ("B", "1048576", "MiB", "mebibyte, mebibytes"),
    ("B", "1073741824", "GiB", "gibibyte, gibibytes"),
    ("B", "1099511627776", "TiB", "tebibyte, tebibytes"),
    ("B", "1125899906842624", "PiB", "pebibyte, pebibytes"),
    ("%", "1", "%", "percent, per cent, pct"),
]

# Legal forms that end an organisation's name, and the short spelling of those that have one.
LEGAL_FORMS = (
    "inc incorporated corp corporation co company ltd limited llc llp lp plc gmbh ag kg sa sas sarl srl spa bv nv oy oyj ab as asa "
    "pty pvt private kk se ulc").split()
LEGAL_SPELLINGS = {"incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd", "private": "pvt"}

# Words before and after a person's name.
HONORIFICS = "mr mrs ms miss mx dr prof sir dame".split()
GENERATIONS = "jr sr ii iii iv phd md".split()

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs e.g i.e cf fig approx".split()

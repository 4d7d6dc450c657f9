"""Category vocabularies of the statistical extracts.

Fixed values: these strings must equal the published category names exactly,
because the analyses select rows by them.
"""

# --- fixed values -----------------------------------------------------------
MISSING_MARKERS = ("", ".", "..")

DOMESTIC_METRICS = ("Viajes", "Pernoctaciones", "Duración media de los viajes",
                    "Gasto total", "Gasto medio por persona")
TRIPS = "Viajes"
SPEND_TOTAL = "Gasto total"
SPEND_PER_PERSON = "Gasto medio por persona"
DURATION_PREFIX = "Duraci"          # matched with LIKE 'Duraci%'

LEISURE = "Ocio, recreo y vacaciones"
BUSINESS = "Negocios y otros motivos profesionales"
FAMILY = "Visitas a familiares o amigos"
OTHER = "Otros motivos"
MAIN_MOTIVES = (LEISURE, BUSINESS, FAMILY, OTHER)
TOTAL = "Total"

LEISURE_SUBMOTIVES = (
    ("sol_playa", "Turismo de sol y playa"),
    ("cultural", "Turismo cultural"),
    ("naturaleza", "Turismo de naturaleza"),
    ("deportivo", "Turismo deportivo"),
    ("termal", "Turismo termal y de bienestar"),
    ("compras", "Turismo de compras"),
    ("otro_ocio", "Otro tipo de turismo de ocio"),
)

FOREIGN_MOTIVES = ("Ocio, recreo y vacaciones", "Negocios", "Otros motivos")
FOREIGN_MOTIVE_PREFIXES = (("ocio", "Ocio%"), ("negocios", "Negocios%"), ("otros", "Otros%"))

MARKET = "De mercado"
NON_MARKET = "No de mercado"
MARKET_LEVEL1 = ("De mercado", "Resto de mercado")
LODGING_LEVEL2 = (
    ("hotel", "Hotelero"),
    ("alquiler", "Vivienda en alquiler"),
    ("rural", "Casa rural"),
    ("camping", "Camping"),
    ("propiedad", "Vivienda en propiedad"),
    ("familiares", "Vivienda de familiares o amigos"),
    ("resto_no_mercado", "Resto de no mercado"),
)

# Survey name -> accommodation type: first LIKE pattern that matches wins.
SURVEY_TYPE_PATTERNS = (
    ("%Hotelera", "Hotelero"),
    ("%Apartamentos%", "Apartamento turístico"),
    ("%Campings", "Camping"),
    ("%Rural", "Turismo rural"),
    ("%Albergues", "Albergue"),
)
ACCOMMODATION_TYPES = (
    ("hotel", "Hotelero"),
    ("apto", "Apartamento turístico"),
    ("camping", "Camping"),
    ("rural", "Turismo rural"),
    ("albergue", "Albergue"),
)
RESIDENCE_PATTERNS = (("Residentes en Espa%", "Nacional"),
                      ("Residentes en el Extranjero", "Extranjero"))
NATIONAL = "Nacional"
FOREIGN = "Extranjero"
TRAVELLERS = "Viajeros"
NIGHTS = "Pernoctaciones"
CAPACITY_METRIC = "Número de plazas estimadas"

SEASONALITY_LEVELS = ("Baja", "Media", "Alta")
DESTINATION_CLASSES = ("Tradicional masivo", "Alternativo", "Intermedio")
GRID_CLASSES = ("Masivo estacional", "Internacional desestacionalizado",
                "Estacional nacional", "Alternativo nacional", "Sin clasificar")
METRIC_CHOICES = ("Total Turismo", "Total Turistas Extranjeros", "Total Viajes Nacionales")
# --- end fixed values -------------------------------------------------------

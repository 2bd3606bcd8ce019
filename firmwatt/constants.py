"""Fixed values. They must equal the published ones for the results to match."""

EARTH_RADIUS_KM = 6371.0
GROUND_COVER_RATIO = 2.0 / 7.0

# Terrain roughness (free, inside the farm) and wake expansion.
OFFSHORE_TERRAIN = (0.0002, 0.03, 0.04)
ONSHORE_TERRAIN = (0.055, 0.05, 0.075)

# Pressure readings from this value up are rejected.
PRESSURE_LIMIT = 3000.0

# Accepted spellings of the module technology and their code.
TECHNOLOGY_CODES = {
    "Mono-c-Si": "monoSi",
    "monoSi": "monoSi",
    "monosi": "monoSi",
    "c-Si": "monoSi",
    "xsi": "monoSi",
    "mtSiMono": "monoSi",
    "Multi-c-Si": "multiSi",
    "multiSi": "multiSi",
    "multisi": "multiSi",
    "mc-Si": "multiSi",
    "EFG mc-Si": "multiSi",
    "polySi": "poliSi",
    "polysi": "poliSi",
    "mtSiPoly": "poliSi",
    "CIS": "cis",
    "cis": "cis",
    "CIGS": "cigs",
    "cigs": "cigs",
    "CdTe": "cdte",
    "cdte": "cdte",
    "Thin Film": "cdte",
    "GaAs": "cdte",
    "amorphous": "amorphous",
    "asi": "amorphous",
    "a-Si / mono-Si": "amorphous",
    "2-a-Si": "amorphous",
    "3-a-Si": "amorphous",
    "Si-Film": "amorphous",
    "HIT-Si": "amorphous",
}

# Perez (1990) coefficients, one row per clearness bin:
# lower edge, f11, f12, f13, f21, f22, f23.
PEREZ_BINS = [
    (0.0, -0.008, 0.588, -0.062, -0.060, 0.072, -0.022),
    (1.065, 0.130, 0.683, -0.151, -0.019, 0.066, -0.029),
    (1.23, 0.330, 0.487, -0.221, 0.055, -0.064, -0.026),
    (1.5, 0.568, 0.187, -0.295, 0.109, -0.152, -0.014),
    (1.95, 0.873, -0.392, -0.362, 0.226, -0.462, 0.001),
    (2.8, 1.132, -1.237, -0.412, 0.288, -0.823, 0.056),
    (4.5, 1.060, -1.600, -0.359, 0.264, -1.127, 0.131),
    (6.2, 0.678, -0.327, -0.250, 0.156, -1.377, 0.251),
]

# Band-gap energy at reference conditions and its temperature
# slope (De Soto 2006), and the Boltzmann constant in eV/K.
BAND_GAP_EV = 1.121
BAND_GAP_SLOPE = -0.0002677
BOLTZMANN_EV = 8.617332478e-05

# Sample voltages of an inverter relative to its nominal one: scale and offset.
INVERTER_LEVELS = {"Vmin": (0.874, 9.93), "Vnom": (1.0, 0.0), "Vmax": (1.123, 66.45)}
POINTS_PER_LEVEL = 7

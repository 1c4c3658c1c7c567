"""Name spellings, default prices, thresholds and formats that results depend on."""

# fixed values: state abbreviations and spellings -> canonical state
STATE_SPELLINGS = {
    "AP": "Andhra Pradesh", "AR": "Arunachal Pradesh", "AS": "Assam", "BR": "Bihar",
    "CG": "Chhattisgarh", "GA": "Goa", "GJ": "Gujarat", "HR": "Haryana", "HP": "Himachal Pradesh",
    "JK": "Jammu and Kashmir", "JH": "Jharkhand", "KA": "Karnataka", "KL": "Kerala",
    "MP": "Madhya Pradesh", "MH": "Maharashtra", "MN": "Manipur", "ML": "Meghalaya", "MZ": "Mizoram",
    "NL": "Nagaland", "OR": "Odisha", "OD": "Odisha", "PB": "Punjab", "RJ": "Rajasthan",
    "SK": "Sikkim", "TN": "Tamil Nadu", "TS": "Telangana", "TR": "Tripura", "UP": "Uttar Pradesh",
    "UK": "Uttarakhand", "WB": "West Bengal",
    "Tamilnadu": "Tamil Nadu", "Andhra": "Andhra Pradesh", "Arunachal": "Arunachal Pradesh",
    "Himachal": "Himachal Pradesh", "Madhya": "Madhya Pradesh", "Uttar": "Uttar Pradesh",
    "West": "West Bengal", "J&K": "Jammu and Kashmir", "Jammu & Kashmir": "Jammu and Kashmir",
    "Orissa": "Odisha", "Pondicherry": "Puducherry", "Pondichery": "Puducherry",
}

# fixed values: older or variant district spellings -> canonical district
DISTRICT_SPELLINGS = {
    "Kasargod": "Kasaragod", "Kasargode": "Kasaragod", "Kasaragode": "Kasaragod", "Mewat": "Nuh",
    "Gurgaon": "Gurugram", "Bangalore": "Bengaluru Urban", "Bangalore Urban": "Bengaluru Urban",
    "Bangalore Rural": "Bengaluru Rural", "Bangaluru": "Bengaluru Urban", "Calcutta": "Kolkata",
    "Calicut": "Kozhikode", "Cochin": "Ernakulam", "Trivandrum": "Thiruvananthapuram",
    "Trichy": "Tiruchirappalli", "Trichirappalli": "Tiruchirappalli", "Madras": "Chennai",
    "Bombay": "Mumbai", "Poona": "Pune", "Allahabad": "Prayagraj", "Prayag": "Prayagraj",
    "Benares": "Varanasi", "Banaras": "Varanasi", "Kashi": "Varanasi", "Mysore": "Mysuru",
    "Mangalore": "Dakshina Kannada", "Mangaluru": "Dakshina Kannada", "Bellary": "Ballari",
    "Belgaum": "Belagavi", "Bijapur": "Vijayapura", "Gulbarga": "Kalaburagi", "Hubli": "Dharwad",
    "Shimoga": "Shivamogga", "Tumkur": "Tumakuru", "Chikmagalur": "Chikkamagaluru",
    "Chikballapur": "Chikkaballapur",
}

# fixed values: crop spellings -> standard crop
CROP_SPELLINGS = {
    "Paddy": "Rice", "Paddy Rice": "Rice", "Rice (Paddy)": "Rice",
    "Wheat Grain": "Wheat", "Wheat (Grain)": "Wheat",
    "Onions": "Onion", "Onion (Dry)": "Onion",
    "Tomatoes": "Tomato", "Tomato (Fresh)": "Tomato",
    "Potatoes": "Potato", "Potato (Fresh)": "Potato",
    "Chilli": "Chili", "Chillies": "Chili", "Red Chili": "Chili", "Red Chilli": "Chili",
    "Green Chili": "Chili", "Green Chilli": "Chili",
    "Turmeric (Dry)": "Turmeric", "Turmeric Powder": "Turmeric",
    "Ginger (Fresh)": "Ginger", "Ginger (Dry)": "Ginger",
    "Garlic (Dry)": "Garlic", "Garlic (Fresh)": "Garlic",
}

# fixed values: (crop, min, max, avg) typical price per quintal, in match order
CROP_DEFAULT_PRICES = [
    ("Wheat", 1800.0, 2200.0, 2000.0), ("Rice", 1800.0, 2500.0, 2150.0),
    ("Maize", 1500.0, 2000.0, 1750.0), ("Cotton", 5000.0, 7000.0, 6000.0),
    ("Sugarcane", 2500.0, 3500.0, 3000.0), ("Groundnut", 5000.0, 7000.0, 6000.0),
    ("Tomato", 800.0, 2000.0, 1400.0), ("Potato", 600.0, 1200.0, 900.0),
    ("Onion", 1000.0, 2500.0, 1750.0), ("Soyabean", 3500.0, 5000.0, 4250.0),
    ("Mustard Seed", 4000.0, 6000.0, 5000.0), ("Sunflower", 4500.0, 6500.0, 5500.0),
    ("Barley", 1500.0, 2000.0, 1750.0), ("Sorghum", 1800.0, 2500.0, 2150.0),
    ("Gram", 4000.0, 6000.0, 5000.0), ("Turmeric", 6000.0, 10000.0, 8000.0),
    ("Chili", 8000.0, 15000.0, 11500.0), ("Grapes", 3000.0, 6000.0, 4500.0),
    ("Cashew", 8000.0, 12000.0, 10000.0), ("Coconut", 3000.0, 5000.0, 4000.0),
    ("Arecanut", 15000.0, 25000.0, 20000.0), ("Coffee", 8000.0, 12000.0, 10000.0),
    ("Pomegranate", 4000.0, 8000.0, 6000.0), ("Pigeon Pea", 5000.0, 8000.0, 6500.0),
    ("Ragi", 2500.0, 4000.0, 3250.0), ("Jowar", 2000.0, 3000.0, 2500.0),
]
FALLBACK_PRICES = (3000.0, 5000.0, 4000.0)

# fixed values: placeholders that stand for a missing key
PLACEHOLDERS = ("unknown", "nan", "")

# fixed values: lags and row frames of the series features
LAGS = (1, 7, 30, 90, 365)
FRAMES = (7, 30, 90)

# fixed values: date text formats tried in order, each with the shape of text it can read
DATE_FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
)

# fixed values: physical column names accepted per panel column, in order of preference
COLUMN_ALIASES = {
    "date": ["date", "date_time", "timestamp", "Reported Date", "reported_date", "Datesk", "month"],
    "state": ["state", "state_name", "state_name_english", "stateName"],
    "district": ["district", "district_name", "district_name_english", "districtName"],
    "crop": ["crop", "crops", "commodity", "variety", "commodity_name", "Item_Name"],
    "price": ["price", "modal_price", "Modal Price (Rs./Quintal)", "avg_price", "average_price", "avg_modal_price"],
    "min_price": ["min_price", "Min Price (Rs./Quintal)", "min", "minimum_price", "avg_min_price"],
    "max_price": ["max_price", "Max Price (Rs./Quintal)", "max", "maximum_price", "avg_max_price"],
}

# fixed values: rename list of the merge stage, several physical names per panel column
COMMON_NAMES = {
    "date": ["date", "Date", "arrival_date"], "state": ["state", "State"], "district": ["district", "District"],
    "crop": ["crop", "Crop", "Commodity"],
    "price": ["price", "Price", "Modal_Price", "modal_price"],
    "min_price": ["min_price", "Min_Price"], "max_price": ["max_price", "Max_Price"],
}

# fixed values: names used by the market portal
PORTAL_NAMES = {
    "date": ["date", "arrival_date"], "crop": ["commodity", "commodity_name", "cmdt_name"],
    "state": ["state", "state_name"], "district": ["district", "district_name"],
    "market": ["market", "market_name"], "price": ["modal_price", "price"],
    "min_price": ["min_price"], "max_price": ["max_price"],
}

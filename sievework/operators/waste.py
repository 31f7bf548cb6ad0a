"""The taxonomy and guidance for waste photos, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.operators.taxonomy import mapping_table

# Dataset, source class, parent, unified class, role, safety level, disposal group, confidence and reason of the mapping.
TAXONOMY = [
    ("trashnet", "cardboard", "Recyclable", "Cardboard", "material", "S1", "Cardboard Recycling", "HIGH", "Direct material-level label."),
    ("trashnet", "glass", "Recyclable", "Glass", "material", "S1", "Glass Recycling", "HIGH", "Direct material-level label."),
    ("trashnet", "metal", "Recyclable", "Metal", "material", "S1", "Metal Recycling", "HIGH", "Direct material-level label."),
    ("trashnet", "paper", "Recyclable", "Paper", "material", "S1", "Paper Recycling", "HIGH", "Direct material-level label."),
    ("trashnet", "plastic", "Recyclable", "Plastic", "material", "S1", "Plastic Recycling", "HIGH", "Direct material-level label."),
    ("trashnet", "trash", "Residual", "Residual", "residual", "S0", "Residual Waste", "MEDIUM", "Generic TrashNet label; safest unified representation is residual waste."),
    ("realwaste", "cardboard", "Recyclable", "Cardboard", "material", "S1", "Cardboard Recycling", "HIGH", "Direct material-level label."),
    ("realwaste", "food organics", "Organic", "Food Organics", "organic", "S0", "Organic Waste", "HIGH", "Direct organic-waste label."),
    ("realwaste", "glass", "Recyclable", "Glass", "material", "S1", "Glass Recycling", "HIGH", "Direct material-level label."),
    ("realwaste", "metal", "Recyclable", "Metal", "material", "S1", "Metal Recycling", "HIGH", "Direct material-level label."),
    ("realwaste", "miscellaneous trash", "Residual", "Residual", "residual", "S0", "Residual Waste", "HIGH", "Dataset explicitly identifies miscellaneous trash."),
    ("realwaste", "paper", "Recyclable", "Paper", "material", "S1", "Paper Recycling", "HIGH", "Direct material-level label."),
    ("realwaste", "plastic", "Recyclable", "Plastic", "material", "S1", "Plastic Recycling", "HIGH", "Direct material-level label."),
    ("realwaste", "textile trash", "Recyclable", "Textile", "material", "S1", "Textile Recovery", "HIGH", "Direct textile-waste label."),
    ("realwaste", "vegetation", "Organic", "Vegetation", "organic", "S0", "Organic Waste", "HIGH", "Direct vegetation/organic label."),
    ("ewaste", "battery", "Special", "Battery", "safety_critical", "S3", "Battery Collection", "HIGH", "Battery is explicitly identifiable and requires special handling."),
    ("ewaste", "keyboard", "E-Waste", "Electronic Device", "e_waste", "S2", "E-Waste Collection", "HIGH", "Electronic peripheral."),
    ("ewaste", "mobile", "E-Waste", "Electronic Device", "e_waste", "S2", "E-Waste Collection", "HIGH", "Electronic consumer device."),
    ("ewaste", "mouse", "E-Waste", "Electronic Device", "e_waste", "S2", "E-Waste Collection", "HIGH", "Electronic peripheral."),
    ("ewaste", "printer", "E-Waste", "Electronic Device", "e_waste", "S2", "E-Waste Collection", "HIGH", "Electronic device."),
    ("ewaste", "player", "E-Waste", "Electronic Device", "e_waste", "S2", "E-Waste Collection", "HIGH", "Electronic media device."),
    ("ewaste", "pcb", "E-Waste", "Electronic Component", "e_waste", "S2", "E-Waste Collection", "HIGH", "Printed circuit board/electronic component."),
    ("ewaste", "microwave", "E-Waste", "Large Electronic Appliance", "e_waste", "S2", "E-Waste Collection", "HIGH", "Electrical appliance."),
    ("ewaste", "television", "E-Waste", "Large Electronic Appliance", "e_waste", "S2", "E-Waste Collection", "HIGH", "Electrical/electronic appliance."),
    ("ewaste", "washing machine", "E-Waste", "Large Electronic Appliance", "e_waste", "S2", "E-Waste Collection", "HIGH", "Large electrical appliance."),
    ("phenomsg", "hazardous", "Hazardous", "Hazardous Waste", "stream", "S3", "Hazardous Waste Collection", "HIGH", "Source dataset explicitly identifies hazardous waste."),
    ("phenomsg", "non-recyclable", "Residual", "Residual", "stream", "S0", "Residual Waste", "HIGH", "Source dataset explicitly identifies non-recyclable waste."),
    ("phenomsg", "organic", "Organic", "Organic Stream", "stream", "S0", "Organic Waste", "HIGH", "Source label identifies the broad organic waste stream without specifying a material."),
    ("phenomsg", "recyclable", "Recyclable", "Recyclable Stream", "stream", "S1", "Recycling Stream", "HIGH", "Source label identifies recyclability but does not specify a material."),
]

# Guidance by unified class.
GUIDANCE = {
    "Battery": "Do not place batteries in regular household waste. Keep them separate and take them to an appropriate battery collection or e-waste facility.",
    "Cardboard": "Keep cardboard clean and dry. Flatten boxes and place them in the appropriate paper/cardboard recycling stream.",
    "Electronic Component": "Do not place electronic components in regular waste. Keep them separate and send them to an authorized e-waste collection facility.",
    "Electronic Device": "Do not dispose of electronic devices with regular waste. Use an authorized e-waste collection or recycling facility.",
    "Food Organics": "Place food waste in the appropriate organic-waste or composting stream. Avoid mixing it with recyclable materials.",
    "Glass": "Empty and rinse the glass item when appropriate, then place it in the designated glass recycling stream. Handle broken glass carefully.",
    "Hazardous Waste": "Do not place hazardous waste in regular recycling or household waste. Keep it separate and use an appropriate hazardous-waste collection facility.",
    "Large Electronic Appliance": "Do not place large electronic appliances in regular waste. Use an authorized e-waste or appliance recycling service.",
    "Metal": "Separate metal from general waste. Clean the item when appropriate and place it in the designated metal recycling stream.",
    "Organic Stream": "Place suitable organic material in the designated organic waste or composting stream.",
    "Paper": "Keep paper clean and dry and place it in the appropriate paper recycling stream.",
    "Plastic": "Empty and rinse the plastic item when appropriate, then place it in the designated plastic recycling stream. Follow your local recycling rules.",
    "Recyclable Stream": "This item appears suitable for a recyclable stream. Keep it clean and dry and follow your local recycling rules.",
    "Residual": "This item appears to belong to residual/general waste. Do not place it with recyclable materials unless local guidelines specifically allow it.",
    "Textile": "Keep textiles separate from regular waste where possible. Reuse, donate, or place them in an appropriate textile collection stream.",
    "Vegetation": "Place vegetation and garden waste in the appropriate organic-waste or composting stream.",
}

# What the web page says for a class whose name holds a word; the first word counts.
WEB_GUIDANCE = [
    ("plastic", "Empty and rinse the plastic item when appropriate, then place it in the designated plastic recycling stream. Follow your local recycling rules."),
    ("paper", "Keep paper clean and dry where possible and place it in the appropriate paper recycling stream."),
    ("cardboard", "Flatten clean cardboard when practical and place it in the appropriate cardboard recycling stream."),
    ("glass", "Place glass in the designated glass collection stream and follow local handling rules."),
    ("metal", "Empty the metal item when appropriate and place it in the designated metal recycling stream."),
    ("organic", "Place organic material in the designated organic or composting stream where available."),
    ("food", "Place organic material in the designated organic or composting stream where available."),
    ("vegetation", "Place organic material in the designated organic or composting stream where available."),
    ("battery", "Do not place this with ordinary household recycling. Use the appropriate hazardous waste or special collection service."),
    ("hazardous", "Do not place this with ordinary household recycling. Use the appropriate hazardous waste or special collection service."),
]
WEB_DEFAULT = "Follow your local waste segregation rules for this category."


def taxonomy(spark: SparkSession) -> DataFrame:
    return mapping_table(spark, TAXONOMY)


def guidance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(GUIDANCE.items()), "class string, guidance string")

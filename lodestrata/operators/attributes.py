"""Attribute sets of whole-slide instances as nested structs, from flat columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import scalars

#: Fixed values that stand where metadata have none.
DEFAULTS = {
    "StudyDate": "19700101", "ContentDate": "19700101", "AcquisitionDate": "19700101", "StudyTime": "000000", "ContentTime": "000000", "AcquisitionTime": "000000",
    "AcquisitionDateTime": "19700101000000", "StudyID": "1", "DeviceSerialNumber": "RESEARCH", "ContainerIdentifier": "RESEARCH-CONTAINER", "FocusMethod": "AUTO",
    "SpecimenIdentifier": "RESEARCH-SPECIMEN", "SpecimenDescription": "Research placeholder specimen",
}
WSI_CLASS = "1.2.840.10008.5.1.4.1.1.77.1.6"
DEPTH_MM = 0.001


def _named(**fields: Column | str | int | float | None) -> Column:
    return F.struct(*(c.alias(n) if isinstance(c, Column) else F.lit(c).alias(n) for n, c in fields.items()))


def code(value: str, scheme: str, meaning: str) -> Column:
    return _named(CodeValue=value, CodingSchemeDesignator=scheme, CodeMeaning=meaning)


def number(value: Column) -> Column:
    """A decimal string of at most 16 characters: ten decimals, without zeros at the end."""
    text = F.regexp_replace(F.format_string("%.10f", value.cast("double")), r"\.?0+$", "")
    return F.when(text == "-0", "0").otherwise(text)


def optical_path(profile: Column | None = None) -> Column:
    profile = F.lit(None).cast("binary") if profile is None else profile
    return _named(
        OpticalPathIdentifier="0", OpticalPathDescription="Default optical path", IlluminationTypeCodeSequence=F.array(code("111744", "DCM", "Brightfield illumination")),
        IlluminationColorCodeSequence=F.array(code("371251000", "SCT", "White")), IlluminationWaveLength=F.lit(550.0).cast("float"), ICCProfile=profile,
    )


def _empty() -> Column:
    return F.array().cast("array<struct<CodeValue:string>>")


def specimen(identifier: Column, description: Column) -> Column:
    identifier, description = F.coalesce(identifier, F.lit(DEFAULTS["SpecimenIdentifier"])), F.coalesce(description, F.lit(DEFAULTS["SpecimenDescription"]))
    return _named(
        SpecimenIdentifier=identifier, SpecimenUID=scalars.uid(F.concat(F.lit("specimen:"), identifier)), SpecimenShortDescription=description, SpecimenDetailedDescription=description,
        IssuerOfTheSpecimenIdentifierSequence=_empty(), SpecimenPreparationSequence=_empty(),
    )


def shared_groups(image_type: Column, row_mm: Column, column_mm: Column) -> Column:
    measures = _named(PixelSpacing=F.array(number(row_mm), number(column_mm)), SliceThickness=number(F.lit(DEPTH_MM)))
    frame_type = _named(FrameType=image_type)
    path = _named(OpticalPathIdentifier="0")
    return _named(PixelMeasuresSequence=F.array(measures), WholeSlideMicroscopyImageFrameTypeSequence=F.array(frame_type), OpticalPathIdentificationSequence=F.array(path))


def dimension_indices(organization: Column) -> Column:
    pointer = lambda keyword: _named(DimensionOrganizationUID=organization, DimensionIndexPointer=keyword, FunctionalGroupPointer="PlanePositionSlideSequence")
    return F.array(pointer("ColumnPositionInTotalImagePixelMatrix"), pointer("RowPositionInTotalImagePixelMatrix"))


def instance_attributes(metadata: dict[str, str] | None = None, *, profile: Column | None = None) -> Column:
    """The attribute set of a row (level, frames, tile, cols, rows, components, bits, photometric, row_mm, column_mm, series_number, instance_number,
    sop_uid, series_uid, study_uid, pyramid_uid, frame_of_reference_uid, dimension_uid), with metadata by keyword.

    Per-frame groups are left out, as tiled-full images have them implied.
    """
    m = {k: v for k, v in (metadata or {}).items() if v}
    given = lambda k, else_=None: F.lit(m.get(k, DEFAULTS.get(k, else_)))
    image_type = F.when(F.col("level") == 0, F.split(F.lit("ORIGINAL|PRIMARY|VOLUME|NONE"), r"\|")).otherwise(F.split(F.lit("DERIVED|PRIMARY|VOLUME|RESAMPLED"), r"\|"))
    whole = lambda c: F.col(c).cast("int")
    return _named(
        SOPClassUID=WSI_CLASS, SOPInstanceUID=F.col("sop_uid"), StudyInstanceUID=F.col("study_uid"), SeriesInstanceUID=F.col("series_uid"), FrameOfReferenceUID=F.col("frame_of_reference_uid"),
        PyramidUID=F.col("pyramid_uid"), PyramidLabel="WSI pyramid", Modality="SM", ImageType=image_type, VolumetricProperties="VOLUME",
        **{k: given(k) for k in ("StudyDate", "StudyTime", "ContentDate", "ContentTime", "AcquisitionDateTime", "StudyID", "DeviceSerialNumber", "ContainerIdentifier", "FocusMethod")},
        AcquisitionDate=F.lit(m.get("ContentDate", DEFAULTS["ContentDate"])), AcquisitionTime=F.lit(m.get("ContentTime", DEFAULTS["ContentTime"])),
        **{k: given(k, "") for k in ("PatientName", "PatientID", "PatientBirthDate", "PatientSex", "AccessionNumber", "StudyDescription", "ReferringPhysicianName")},
        **{k: given(k, "lodestrata") for k in ("Manufacturer", "ManufacturerModelName", "SoftwareVersions")}, Laterality=F.lit(m.get("Laterality")).cast("string"),
        PositionReferenceIndicator="SLIDE_CORNER", Rows=whole("tile"), Columns=whole("tile"), TotalPixelMatrixColumns=F.col("cols"), TotalPixelMatrixRows=F.col("rows"),
        ImagedVolumeWidth=(F.col("cols") * F.col("column_mm")).cast("float"), ImagedVolumeHeight=(F.col("rows") * F.col("row_mm")).cast("float"), ImagedVolumeDepth=F.lit(DEPTH_MM).cast("float"),
        NumberOfFrames=F.col("frames").cast("string"), SamplesPerPixel=whole("components"), PhotometricInterpretation=F.col("photometric"),
        PlanarConfiguration=F.when(F.col("components") > 1, F.lit(0)), BitsAllocated=whole("bits"), BitsStored=whole("bits"), HighBit=whole("bits") - 1, PixelRepresentation=0,
        LossyImageCompression="00", DimensionOrganizationType="TILED_FULL", NumberOfOpticalPaths=1, TotalPixelMatrixFocalPlanes=1, SpecimenLabelInImage="NO", BurnedInAnnotation="NO",
        ExtendedDepthOfField="NO", SeriesNumber=F.col("series_number").cast("string"), InstanceNumber=F.col("instance_number").cast("string"), RepresentativeFrameNumber=1,
        ImageOrientationSlide=F.split(F.lit("1|0|0|0|1|0"), r"\|"), OpticalPathSequence=F.array(optical_path(profile)), AcquisitionContextSequence=_empty(), IssuerOfTheContainerIdentifierSequence=_empty(),
        ContainerTypeCodeSequence=F.array(code("433466003", "SCT", "Microscope slide")),
        SpecimenDescriptionSequence=F.array(specimen(F.lit(m.get("SpecimenIdentifier")).cast("string"), F.lit(m.get("SpecimenDescription")).cast("string"))),
        TotalPixelMatrixOriginSequence=F.array(_named(XOffsetInSlideCoordinateSystem="0", YOffsetInSlideCoordinateSystem="0")),
        SharedFunctionalGroupsSequence=F.array(shared_groups(image_type, F.col("row_mm"), F.col("column_mm"))),
        DimensionOrganizationSequence=F.array(_named(DimensionOrganizationUID=F.col("dimension_uid"))), DimensionIndexSequence=dimension_indices(F.col("dimension_uid")),
    )
